"""Labels of every hour of every user, against a plain version."""

import collections

from sigloom import queries


def test_every_hour_of_a_user_is_labelled(spark, sf_dir):
    events = collections.defaultdict(list)
    for r in queries.events(spark, sf_dir).select("user_id", "t", "event_id", "event_type").collect():
        events[r.user_id].append((r.t, r.event_id, r.event_type))
    want = {}
    for user, found in events.items():
        found.sort()
        runs = [(a[0], b[0], a[2]) for a, b in zip(found, found[1:]) if b[0] > a[0]]
        for i in range(int((found[-1][0] - found[0][0]) // 3600) + 1):
            start = found[0][0] + i * 3600
            met = [label for begin, end, label in runs if begin < start + 3600 and end > start]
            want[user, round(start, 3)] = met[0] if met and None not in met and len(set(met)) == 1 else None
    got = {(r.user_id, round(r.start_s, 3)): r.label for r in queries.window_label_range_join(spark, sf_dir).collect()}
    assert got == want and len(want) > 24 * len(events)
