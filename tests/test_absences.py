"""Absences are counted right whatever the order and the pieces that a key's rows come in."""

import random

import pytest

from tidemark import catalog


def brute(rows):
    out = {}
    for key in {r[1] for r in rows}:
        n = 0
        for _, _, kind in sorted((r for r in rows if r[1] == key), key=lambda r: (r[0] is not None, r[0] or 0)):
            n = 0 if kind == "view" else n + 1
        out[key] = n
    return out


def counted(spark, folder):
    got = catalog.queries()["absence_stream"](spark, str(folder)).collect()
    assert len(got) == len({r.key for r in got})
    return {r.key: r.absent_syncs for r in got}


def written(rows, path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    ids, users, kinds = zip(*rows, strict=True)
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"event_id": pa.array(ids, "int64"), "user_id": pa.array(users, "int64"), "event_type": pa.array(kinds, "string")}), path)


@pytest.fixture()
def small_pieces(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def events():
    draw = random.Random(3)
    rows = [(k, draw.randrange(12), draw.choice(["view", "click", "error", "click", "error", None])) for k in range(600)]
    rows += [(None, 50, "view"), (900, 50, "click"), (901, None, "click"), (902, None, "view"), (2**62 + 1, 51, "view"), (2**62 + 2, 51, None), (3, 52, "click")]
    draw.shuffle(rows)
    return rows


def test_a_key_in_many_pieces(spark, tmp_path, small_pieces):
    rows = events()
    written(rows, tmp_path / "events.parquet")
    assert counted(spark, tmp_path) == brute(rows)


def test_a_table_of_several_files(spark, tmp_path):
    rows = events()
    for k in range(3):
        written(rows[k::3], tmp_path / "events.parquet" / f"part-{k}.parquet")
    assert counted(spark, tmp_path) == brute(rows)
