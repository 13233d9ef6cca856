"""Functions over arrays hand a batch back in bounded pieces."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import arrays as AR
from lexiloom.operators import softlabels as S
from lexiloom.operators import tokens as K

K_LABELS = 16


def labels(tokens):
    ids = np.repeat(tokens[:, None], K_LABELS, 1).astype(np.int32)
    return ids, np.full(ids.shape, 1 / K_LABELS, np.float32)


@pytest.fixture
def made(monkeypatch):
    """The functions that were made Arrow UDFs."""
    found, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, *args: found.append(f) or real(f, *args))
    return found


def test_ranges_cover_all_rows():
    rows = pa.array([[1] * n for n in (0, 3, 4, 0, 50, 1, 0)], pa.list_(pa.int32()))
    for column in (rows, rows.slice(1, 5), pa.array(["ab", None, "abcdefghi", ""])):
        ranges = AR.pieces_of(column, 4)
        assert [i for start, stop in ranges for i in range(start, stop)] == list(range(len(column)))
    assert AR.pieces_of(rows, 4) == [(0, 3), (3, 5), (5, 7)]


def test_labels_of_a_batch_come_in_pieces(spark, made):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    assert S.extract_soft_labels(df, labels).first()["teacher_ids"] == [1] * K_LABELS + [2] * K_LABELS
    batch = pa.array([list(range(1000)) for _ in range(100)], pa.list_(pa.int32()))
    out = list(made[0](iter([batch, batch.slice(7, 60)])))
    assert sum(map(len, out)) == 160
    longest = max(len(piece.field("teacher_ids").flatten()) for piece in out)
    assert longest <= (S.POSITIONS + 1000) * K_LABELS
    ids = pa.concat_arrays([piece.field("teacher_ids") for piece in out])
    assert ids[159].as_py() == np.repeat(np.arange(999), K_LABELS).tolist()


def test_look_ups_cost_a_piece_and_not_the_batch(spark, made):
    """Every piece used to be looked up with all values of its batch."""
    AR.running_sums(F.col("x"))
    batch = pa.array([[i, 1, 2] for i in range(1 << 19)], pa.list_(pa.int32()))
    out = list(made[0](iter([batch.slice(5)])))
    assert len(out) == 2 and out[-1][-1].as_py() == [(1 << 19) - 1, 1 << 19, (1 << 19) + 2]
    assert all(len(piece.values) <= AR.PIECE + 3 for piece in out)


def test_truncation_needs_no_function_over_whole_texts(spark, made):
    df = spark.createDataFrame([("one two three",), ("a",), ("a b",), ("a b  c",)], "text string")
    out = K.truncate_by_span(df, 3, r"\w+|\W+")
    assert sorted(r["text"] for r in out.collect()) == ["a b", "a b", "one two"]
    assert not made
