"""What a Python worker holds after its task."""

from types import SimpleNamespace

import pyarrow as pa
from nearfold.llm import common, line_dedup


def test_worker_gives_back(spark):
    """Small objects freed below one that stays: the allocator alone would keep all of their memory."""
    left = []

    def fn(batches):
        for b in batches:
            many = [bytes(1000) for _ in range(200_000)]
            left.append(bytes(1000))
            del many
            yield b

    run = common.arrow_map(SimpleNamespace(sparkSession=spark, mapInArrow=lambda f, schema: f), fn, "x long")
    before = common.resident()
    assert sum(b.num_rows for b in run(iter([pa.record_batch({"x": [1, 2]})]))) == 2
    assert common.resident() - before < 64 << 20


def test_caches_of_other_operators_go():
    def fn(batches):
        yield from batches

    common.kept("other")["x"] = 1
    common.kept(__name__)["x"] = 2
    list(common._lean(iter([]), fn))
    assert common.kept("other") == {} and common.kept(__name__) == {"x": 2}


def test_lines_in_pieces(monkeypatch):
    texts = ["a b c\nd e f", None, "", "d e f\ng h i" * 40, "a b c"]
    batch = pa.record_batch({"doc_id": pa.array([5, 4, None, 2, 1], pa.int64()), "row": pa.array(range(5), pa.int64()), "text": texts})

    def first():
        best = {}
        for r in pa.Table.from_batches(list(line_dedup._lines(iter([batch])))).to_pylist():
            best[r["id"]] = min(best.get(r["id"], (9, 9, 9)), (r["doc_id"], r["row"], r["line"]))
        return best

    whole = first()
    assert [p.num_rows for p in common.pieces(batch, 2, 12)] == [4, 1] and sum(p.num_rows for p in common.pieces(batch, 2, 1)) == 5
    monkeypatch.setattr(line_dedup, "AT_ONCE", 1)
    assert first() == whole and len(whole) > 2
