"""Alignment of entities: any number of entities per text in linear time, occurrences as numbers, by slices of a batch."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from glyphmill.functions import dictionary as DI
from glyphmill.functions import units as U
from glyphmill.operators import spans as S

ENTITIES = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())]))


def one_by_one(texts, entities):
    """Every occurrence as a Python object, chosen one after another."""
    def choose(text, spans):
        return DI.longest_free(len(text), [s for s in spans if DI.not_in_ascii_word(text, s)], [])

    return DI._arrow(texts, entities, 1, choose)


def rows_of(parts):
    return [x for part in parts for x in part.to_pylist()]


@pytest.mark.parametrize("letters", ["a", "ab", "ab ", "abé ", "aé1 _語😀\n"])
def test_align_equals_one_by_one(monkeypatch, letters):
    """Null and empty texts, lists, entities and names; names with blanks; equal names with other labels; own overlaps."""
    rnd = random.Random(letters)
    some = lambda size: "".join(rnd.choices(letters, k=size))
    entity = lambda: rnd.choice([None, *[{"text": rnd.choice([None, *[some(rnd.randint(0, 5))] * 9]), "label": rnd.choice([None, "", "X", "Y"])} for _ in range(20)]])
    rows = [None, "", *(some(rnd.choice([0, 1, 5, 60, 300])) for _ in range(60))]
    rnd.shuffle(rows)
    texts = pa.array(rows, pa.string())
    entities = pa.array([None if rnd.random() < 0.05 else [entity() for _ in range(rnd.choice([0, 3, 12]))] for _ in rows], ENTITIES)
    for size in (64, 512, 1 << 19):
        monkeypatch.setattr(U, "SLICE", size)
        for a, b in ((texts, entities), (texts.slice(5), entities.slice(5)), (texts.slice(0, 0), entities.slice(0, 0))):
            assert rows_of(DI._aligned(a, b)) == rows_of(one_by_one(a, b))


def test_align_many_entities_of_one_text(spark):
    """60,000 entities, each given twice: telling structs apart by comparing all pairs would take 7 billion steps."""
    df = spark.range(1).selectExpr("transform(sequence(1, 60000), x -> concat('w', lpad(string(x), 5, '0'))) as w")
    df = df.selectExpr("array_join(w, ' ') as text", "transform(concat(w, w), x -> struct(x as text, 'T' as label)) as e")
    began = time.time()
    got = df.select(S.align_entities("text", "e").alias("s")).selectExpr("size(s) as n", "s[59999].start as a", "s[59999].end as b").first()
    assert time.time() - began < 20
    assert tuple(got) == (60_000, 59_999 * 7, 59_999 * 7 + 6)


def test_align_holds_numbers_per_occurrence():
    """Peak memory for 40,000 occurrences in one text, against tuples of Python integers."""
    batch = pa.array([" ".join(f"w{i % 50:02}" for i in range(40_000))]), pa.array([[{"text": f"w{i:02}", "label": "T"} for i in range(50)]], ENTITIES)
    peaks = []
    for align in (one_by_one, DI._aligned):
        tracemalloc.start()
        assert sum(len(part.flatten()) for part in align(*batch)) == 40_000
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert 2 * peaks[1] < peaks[0], peaks
