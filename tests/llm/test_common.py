"""Workers forget what another operator remembered."""

from adjudica.llm import common


def test_a_worker_drops_memories_when_it_changes_operators():
    dropped = []
    common.on_release(lambda: dropped.append(1))
    try:
        first, second = common.task("a")(lambda rows: iter(rows)), common.task("b")(lambda rows: iter(rows))
        assert list(first([1, 2])) == [1, 2] and len(dropped) == 1
        assert list(first([3])) == [3] and len(dropped) == 1
        assert list(second([4])) == [4] and len(dropped) == 2
    finally:
        common._drops.pop()
        common._served[0] = ""
