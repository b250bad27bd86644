import base64
import hashlib
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from hornspark.llm import warc


def records(n=6):
    return [warc.record_bytes(str(i), f"http://x/{i}", warc.base32_sha1(p), len(p), p, None, "2024-01-01T00:00:00Z") for i, p in enumerate(bytes([65 + i]) * (i * 50) for i in range(n))]


def ids(found):
    return [warc.bare_id(f.headers["warc-record-id"]) if f.headers else f"gap:{f.reason}" for f in found]


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(zipped):
    parts = [warc.member(r) if zipped else r for r in records()]
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == list("012345")
    for hit in (2, 3):
        at = sum(map(len, parts[: hit + 1])) - 20  # in the payload; a header's text has no checksum
        data = bytearray(whole)
        data[at] ^= 0x5A
        found = list(warc.salvage(bytes(data)))
        gaps = [f for f in found if f.headers is None]
        assert [x for x in ids(found) if x[0] != "g"] == [str(i) for i in range(6) if i != hit]
        assert [(g.start, g.length) for g in gaps] == [(sum(map(len, parts[:hit])), len(parts[hit]))]
    cut = whole[: len(whole) - 9]
    assert ids(warc.salvage(cut))[:5] == list("01234") and ids(warc.salvage(cut))[5].startswith("gap")
    assert ids(warc.salvage(b"junk" + whole))[1:] == list("012345")
    assert list(warc.salvage(b"")) == [] and [f.length for f in warc.salvage(b"nothing here")] == [12]


def test_salvage_of_random_damage():
    rng = random.Random(3)
    for zipped in (False, True):
        parts = [warc.member(r) if zipped else r for r in records(8)]
        starts = [sum(map(len, parts[:i])) for i in range(9)]
        for _ in range(60):
            data = bytearray(b"".join(parts))
            hits = {rng.randrange(len(data)) for _ in range(rng.randint(1, 3))}
            for h in hits:
                data[h] ^= 1 << rng.randrange(8)
            found = list(warc.salvage(bytes(data)))
            clean = {str(i) for i in range(8) if not any(starts[i] <= h < starts[i + 1] for h in hits)}
            assert clean <= set(ids(found))
            spans = sorted({(f.start, f.length) for f in found})
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == len(data)


def test_several_records_in_a_member():
    r = records(3)
    assert ids(warc.salvage(warc.member(r[0] + r[1]) + warc.member(r[2]))) == list("012")


def test_a_bad_record_of_a_member_costs_only_itself():
    r = records(5)
    bad = r[2].replace(b"CCCC", b"CCXC", 1)  # the member is sound, a block digest is not
    found = list(warc.salvage(warc.member(b"".join([r[0], r[1], bad, r[3], r[4]]))))
    assert ids(found) == ["0", "1", "gap:block digest", "3", "4"]
    gap = found[2]
    assert (gap.inner_start, gap.inner_length) == (len(r[0]) + len(r[1]), len(bad)) and {f.reason for f in found if f.headers} == {None}
    assert ids(warc.salvage(warc.member(b"junk" + r[1]))) == ["gap:version line", "1"]


def test_records_before_the_damage_of_a_member_are_kept():
    r = [warc.record_bytes(str(i), "u", warc.base32_sha1(p), len(p), p, None, "2024-01-01T00:00:00Z") for i, p in enumerate(random.Random(i).randbytes(5000) for i in range(8))]
    whole, after = warc.member(b"".join(r)), warc.member(records(1)[0])
    cut = list(warc.salvage(whole[:23_000]))
    kept = [x for x in ids(cut) if x[0] != "g"]
    assert kept == list("0123") and all("damaged member" in f.reason for f in cut if f.headers)
    gap = next(f for f in cut if f.headers is None)
    assert (gap.start, gap.length, gap.inner_start) == (0, 23_000, sum(map(len, r[:4])))
    for at in (9_000, 26_000, len(whole) - 4):
        data = bytearray(whole + after)
        data[at] ^= 0xFF
        got = list(warc.salvage(bytes(data)))
        names = [x for x in ids(got) if x[0] != "g"]
        assert names[-1] == "0" and got[-1].reason is None  # the next member, untouched
        assert names[:-1] == [str(i) for i in range(8) if str(i) in names[:-1]] and len(names) >= 2 + (at - 6000) // 6000
        assert all(f.block == warc.parse_record(r[int(x)], 0)[1] for f, x in zip(got[:-1], ids(got)) if f.headers)
        assert any(f.headers is None for f in got)


def test_both_kinds_in_one_file():
    r = records(3)
    assert ids(warc.salvage(warc.member(r[0]) + r[1] + warc.member(r[2]))) == list("012")


PAGES = [(3, "http://a", "<p>x</p>"), (1, "http://b c\r\n", "<p>x</p>"), (2, None, None), (7, "u", ""), (9, "é", "straße " * 5000), (9, "é", "straße " * 5000), (10, "z", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "n", "<p>x</p>"), (None, "n", "only")]


def written(spark, tmp_path, pages, **options):
    df = spark.createDataFrame([(*p, "extra", 1) for p in pages], "page_id long, url string, html string, sha string, slot int")
    uri = f"file://{tmp_path}/w"
    manifest = warc.write_pages(df.repartition(3) if pages else df, uri, **options)
    return manifest, warc.read_archives(spark, uri) if pages else None


def test_round_trip(spark, tmp_path):
    manifest, read = written(spark, tmp_path, PAGES, max_bytes=400)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES) and manifest.count() > 3
    got = read.collect()
    assert {r.kind for r in got} == {"record"}
    expected = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        first = min(same, default=None)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = first is not None and first != i
        expected.append((None if i is None else str(i), len(body), digest, "revisit" if again else "response", str(first) if again else None))
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.payload.decode() in {h or "" for _, _, h in PAGES} for r in got if r.record_type == "response")


def test_smaller_payloads_are_responses(spark, tmp_path):
    _, read = written(spark, tmp_path, PAGES, min_bytes=1000)
    assert [(r.record_id, r.record_type) for r in read.collect() if r.record_type == "revisit"] == []


def test_damaged_archives_are_read_on(spark, tmp_path):
    pages = [(i, "u", f"page {i} " * 20) for i in range(30)]
    manifest, _ = written(spark, tmp_path, pages)
    path = re.sub("^file:/+", "/", sorted(r.path for r in manifest.collect())[0])
    with open(path, "r+b") as f:
        f.seek(700)
        f.write(b"\0\0\0\0")
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sum(r.kind == "gap" for r in got) == 1 and sum(r.kind == "record" for r in got) >= 28


def test_gaps_are_logged_and_losses_raise(spark, tmp_path):
    pages = [(i, "u", f"page {i} " * 20) for i in range(30)]
    manifest, _ = written(spark, tmp_path, pages)
    uri = f"file://{tmp_path}/w"
    assert warc.checked(spark, uri, manifest).count() == 30
    with open(re.sub("^file:/+", "/", sorted(r.path for r in manifest.collect())[0]), "r+b") as f:
        f.seek(700)
        f.write(b"\0\0\0\0")
    with pytest.raises(RuntimeError, match="30 records written"):
        warc.checked(spark, uri, manifest)
    log = spark.read.parquet(f"{uri}-gaps").collect()
    assert len(log) == 1 and log[0].length > 0 and log[0].reason


def test_only_archives_of_the_manifest_count(spark, tmp_path):
    """What an attempt that does not count left behind is not read, and a commit may run again."""
    manifest, read = written(spark, tmp_path, PAGES)
    (tmp_path / "w" / "_part-000000-00000-999.warc.gz").write_bytes(warc.member(records(2)[1]))
    names = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"), "records", "bytes")
    again = warc.commit(names, f"file://{tmp_path}/w")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect())) and read.count() == len(PAGES)
    with pytest.raises(Exception, match="(?i)no such file|not exist|failed"):
        warc.commit(spark.createDataFrame([("nothing.warc.gz", 1, 1)], "name string, records long, bytes long"), f"file://{tmp_path}/w")


RETRY = """
import sys
sys.path.insert(0, {repo!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from hornspark.llm import warc
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

@F.udf("string")
def fails_late(i, text):
    if TaskContext.get().attemptNumber() == 0 and i == {last}:
        raise ValueError("lost")
    return text

rows = spark.createDataFrame([(str(i), "u", f"text {{i}} " * 50) for i in range({last} + 1)], "id string, url string, html string").coalesce(1)
rows = rows.select("id", "url", F.unhex(F.sha1("html")).alias("digest"), F.length("html").cast("long").alias("n_bytes"), fails_late(F.col("id").cast("int"), "html").cast("binary").alias("payload"), F.lit(None).cast("string").alias("refers_to"))
manifest = warc.write_records(rows, {uri!r}, 3000, "2024-01-01T00:00:00Z")
print(sorted(int(r.record_id) for r in warc.checked(spark, {uri!r}, manifest).collect()) == list(range({last} + 1)))
"""


def test_a_retried_task_neither_doubles_nor_loses(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = RETRY.format(repo=repo, uri=f"file://{tmp_path}/w", last=299)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([repo, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env)
    assert done.stdout.split() == ["True"], done.stderr[-2000:]
    left = [p.name for p in (tmp_path / "w").iterdir() if p.name.startswith("_")]
    assert left  # the first attempt had written archives


def test_no_pages(spark, tmp_path):
    manifest, _ = written(spark, tmp_path, [])
    assert manifest.count() == 0


def test_op4_without_revisits(spark):
    got = warc.op4_warc(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
