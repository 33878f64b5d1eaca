from sensorloom.functions import hysteresis as hy

P = hy.Policy(0.6, 2, 0.5, 2)


def run(rows, policy=P, start=hy.START):
    machine, events = start, []
    for i, row in enumerate(rows):
        machine, event = hy.advance(machine, *row, policy)
        if event:
            events.append((i, event))
    return machine, events


def test_entry_needs_consecutive_rows():
    hit, miss = (0, True, False, True), (0, False, False, True)
    assert run([hit, miss, hit])[1] == []
    assert run([hit, hit])[1] == [(1, ("new_alert", -1, 0))]


def test_exit_wins_over_switch_on_the_same_row():
    confirmed = (0, 2, 1, 1)
    machine, events = run([(2, True, True, True)], start=confirmed)
    assert events == [(0, ("cleared", 0, -1))] and machine == hy.START


def test_switch_and_gap_rules():
    confirmed = (0, hy.NONE, 0, 0)
    assert run([(2, True, False, True), (2, True, False, True)], start=confirmed)[1] == [(1, ("class_change", 0, 2))]
    gap = (0, False, False, False)
    assert hy.advance((0, 2, 1, 1), *gap, P) == ((0, 2, 1, 1), None)
    assert hy.advance((hy.NONE, 2, 1, 0), *gap, P) == (hy.START, None)


def test_block_transfer_equals_running_from_every_start():
    import random

    rng = random.Random(3)
    rows = [(d := rng.randrange(3), d != 1 and rng.random() < 0.6, rng.random() < 0.4, rng.random() < 0.9) for _ in range(200)]
    table = hy.block_transfer(rows, 3, 1, P)
    for start in hy.machines(3, 1, P):
        assert table[start] == run(rows, start=start)[0]
