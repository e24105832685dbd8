"""Packed responses: byte ranges, filters, damage."""

import glob
import hashlib

import pytest

from tracewell.sources import packs

ROWS = [(f"https://a.com/{i}" if i % 7 else None, [200, 404, None][i % 3], [{"etag": str(i)}, {}, None][i % 3], [bytes([i % 256]) * (i * 37 % 5000), b"", None][(i // 3) % 3], None, True) for i in range(150)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    packs.register(spark)
    path = str(tmp_path_factory.mktemp("packs") / "p")
    spark.createDataFrame(ROWS, packs.SCHEMA).repartition(3).write.format("response_pack").mode("append").save(path)
    return path


def key(r):
    return (r[0], r[1], None if r[2] is None else tuple(r[2].items()), None if r[3] is None else bytes(r[3]))


@pytest.mark.parametrize("split", [97, 4000, 1 << 26])
def test_every_split_gives_all_records_once(spark, folder, split):
    got = spark.read.format("response_pack").option("splitBytes", split).load(folder)
    rows = got.collect()
    assert sorted(map(key, rows), key=repr) == sorted(map(key, ROWS), key=repr)
    assert all(r["intact"] and (r["sha256"] is None) == (r["body"] is None) and (r["body"] is None or hashlib.sha256(r["body"]).hexdigest() == r["sha256"]) for r in rows)


def test_filters_are_pushed(spark, folder, capsys):
    got = spark.read.format("response_pack").load(folder).where("status >= 200 AND status < 300 AND url LIKE 'https://a.com/1%' AND length(body) > 10")
    assert {r["url"] for r in got.collect()} == {r[0] for r in ROWS if r[1] == 200 and r[0] and r[0].startswith("https://a.com/1") and r[3] and len(r[3]) > 10}
    got.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "status" in pushed and "url" in pushed
    reader = packs.PackReader({"path": folder})
    left = list(reader.pushFilters([packs.EqualTo(("status",), 404), packs.EqualTo(("sha256",), "x")]))
    assert len(left) == 1 and reader.fits({"status": 404, "url": None}) and not reader.fits({"status": None, "url": "u"})


def test_damage_is_told_apart(spark, tmp_path):
    packs.register(spark)
    path = f"{tmp_path}/p"
    rows = [(f"https://a.com/{i}", 200, None, bytes(str(i) * 400, "ascii"), None, True) for i in range(30)]
    spark.createDataFrame(rows, packs.SCHEMA).coalesce(1).write.format("response_pack").mode("append").save(path)
    [file] = glob.glob(f"{path}/*.pack")
    raw = bytearray(open(file, "rb").read())
    marker = bytes(raw[len(packs.MAGIC) : len(packs.MAGIC) + packs.MARKER])
    places = [i for i in range(len(packs.MAGIC) + 1, len(raw)) if raw[i : i + packs.MARKER] == marker]
    raw[places[4] - 3] ^= 255  # the body of record 3
    raw[places[10] + packs.MARKER + 5] = 0  # the head of record 10
    open(file, "wb").write(raw[: places[29] + packs.MARKER + 30])  # the last record is torn
    got = {r["url"]: r for r in spark.read.format("response_pack").option("splitBytes", 300).load(path).collect()}
    assert not got["https://a.com/3"]["intact"] and got["https://a.com/3"]["body"] is None
    assert set(got) == {f"https://a.com/{i}" for i in range(30)} - {"https://a.com/10", "https://a.com/29"}
    assert sum(r["intact"] for r in got.values()) == 27


def test_empty_folders_and_overwriting(spark, tmp_path):
    packs.register(spark)
    assert spark.read.format("response_pack").load(f"{tmp_path}/none").count() == 0
    one = spark.createDataFrame(ROWS[:5], packs.SCHEMA)
    one.write.format("response_pack").mode("append").save(f"{tmp_path}/p")
    one.limit(0).write.format("response_pack").mode("append").save(f"{tmp_path}/p")
    assert spark.read.format("response_pack").load(f"{tmp_path}/p").count() == 5
    one.limit(2).write.format("response_pack").mode("overwrite").save(f"{tmp_path}/p")
    assert spark.read.format("response_pack").load(f"{tmp_path}/p").count() == 2
