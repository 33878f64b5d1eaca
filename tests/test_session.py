from sensorloom.streaming import session as ss

CONFIG = ss.SessionConfig(required=("a", "b"), max_pending=2)


def offer(state, ts, name, value, now=0):
    return ss.offer(state, {"ts": ts, "measurement_type": name, "value": value, "unit": "u"}, now, CONFIG)


def test_complete_late_and_duplicate():
    state = ss.new_state()
    assert offer(state, 10, "a", 1.0) == []
    assert offer(state, 10, "a", 1.0) == []  # identical reading
    done = offer(state, 10, "b", 2.0)
    assert done[0]["kind"] == "result" and done[0]["sample_no"] == 1
    assert offer(state, 10, "a", 1.0)[0]["reason"] == "late"


def test_conflict_eviction_and_timeout():
    state = ss.new_state()
    offer(state, 10, "a", 1.0)
    assert offer(state, 10, "a", 5.0)[0]["reason"] == "conflicting_duplicate"
    for ts in (20, 30):
        offer(state, ts, "a", 1.0)
    assert offer(state, 40, "a", 1.0)[0] == {"ts": 20, "kind": "quality", "status": "rejected", "reason": "incomplete_timeout"}
    assert [o["ts"] for o in ss.expire(state, 31_000, CONFIG)] == [30, 40]
