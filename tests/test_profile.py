import csv
import io
import random
import re

import pytest

from trellium.functions.csv_text import csv_fields, header_names
from trellium.operators import profile
from pyspark.sql import functions as F

FILES = {
    "plain.csv": "id,a,b\n1,2,x\n2,3,yy\n3,4,z\n",
    "no newline.csv": "id,a\n1,2\n2,3",
    "blank.csv": "id,a\n\n1,2\n\n",
    "bare.csv": "1,2\n3,4\n5,6\n",
    "crlf.csv": "id,a\r\n1,2\r\n2,3\r\n",
    "quoted+100%.csv": '"id","a, b"\n1,"x\ny"\n2,"say ""hi"""\n',
    "open.csv": 'id,a\n1,"never closed\n2,x',
    "stray.csv": 'id,size\n1,5" pipe\n2,6" pipe\n',
    "empty.csv": "",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("profiles")
    for name, content in FILES.items():
        (path / name).write_bytes(content.encode())
    return path


def by_name(df):
    return {r.dataset.rsplit("/", 1)[1]: r for r in df.collect()}


def read(content):
    return list(csv.reader(io.StringIO(content)))


def test_line_profile(spark, folder):
    got = by_name(profile.profile_files(spark, str(folder)))
    assert set(got) == set(FILES) - {"empty.csv"}
    for name, content in FILES.items():
        if not content:
            continue
        lines = len(content.splitlines())
        row = got[name]
        assert row.n_lines == lines, name
        assert row.row_count == lines - row.has_header, name
        shown = read(content)[:10]
        assert row.preview == (shown[1:] if row.has_header else shown), name
        assert row.columns == (shown[0] if row.has_header else []), name
        assert row.column_count == len(row.columns)
    assert got["plain.csv"].has_header and got["crlf.csv"].has_header and got["quoted+100%.csv"].has_header
    assert not got["bare.csv"].has_header
    assert got["quoted+100%.csv"].header == ["id", "a, b"]


def test_record_profile(spark, folder):
    got = by_name(profile.profile_records(spark, str(folder)))
    for name, content in FILES.items():
        if not content:
            continue
        records = read(content)
        row = got[name]
        assert row.columns == (records[0] if records else []), name
        assert row.row_count == max(len(records) - 1, 0), name
        assert row.preview == records[1:6], name
        assert row.raw_preview == "\n".join(content.splitlines()[:8]), name


def random_csv(rng, n):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "text"])
    for i in range(n):
        body = "".join(rng.choice(["a", '"', "\n", ",", " b", "\n\n", '""']) for _ in range(rng.randrange(12)))
        writer.writerow([i, body])
    return out.getvalue()


def test_records_over_many_splits(spark, tmp_path):
    """Counts hold when every file is cut into many blocks, wherever the cuts fall."""
    rng = random.Random(7)
    contents = {f"f{i}.csv": random_csv(rng, 300 + 50 * i) for i in range(4)}
    for name, content in contents.items():
        (tmp_path / name).write_text(content)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = profile.read_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 40
        got = by_name(profile.count_records(lines))
        heads = by_name(profile.first_records(lines, 22))
        shown = by_name(profile.profile_records(spark, str(tmp_path)))
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    for name, content in contents.items():
        records = read(content)
        assert got[name].n_records == len(records), name
        assert got[name].n_lines == len(content.splitlines()), name
        assert [read(r)[0] if r else [] for r in heads[name].records] == records[:22], name
        assert shown[name].preview == records[1:6], name


def test_first_records_go_past_huge_fields(spark, tmp_path):
    content = 'id,t\n1,"' + "\n" * 500 + '"\n2,x\n3,y\n'
    (tmp_path / "f.csv").write_text(content)
    got = profile.first_records(profile.read_lines(spark, str(tmp_path)), 4).first()
    assert [read(r)[0] for r in got.records] == read(content)[:4]


def test_folder_as_one_data_set(spark, tmp_path):
    part = tmp_path / "d"
    part.mkdir()
    for i in range(30):
        (part / f"part-{i:02d}.csv").write_text(f"id,name\n{i},x\n")
    row = profile.profile_files(spark, str(part), "folder", headers_in_parts=True).first()
    assert row.has_header and (row.row_count, row.header) == (30, ["id", "name"])
    assert row.preview == [[str(i), "x"] for i in range(9)]


@pytest.mark.parametrize("line", ["a,b", "", ",", "a,,", '"a,b",c', '"a""b",c', '"ab"cd,e', 'a"b,c', ",a", '"open'])
def test_fields_agree_with_the_csv_module(spark, line):
    got = spark.createDataFrame([(line,)], "l string").select(csv_fields(F.col("l"))).first()[0]
    assert got == (read(line)[0] if line else [])


def test_header_names_are_trimmed_and_filled(spark):
    got = spark.createDataFrame([(' id , "Price ",,"x"',)], "l string").select(header_names(F.col("l"))).first()[0]
    assert got == ["id", "Price", "x"]


@pytest.mark.parametrize(
    "content",
    [
        "id,name\n" + "".join(f"{i},{'n' * (i % 5 + 1)}\n" for i in range(30)),
        "".join(f"{i},{i * 2}\n" for i in range(30)),
        "code,kind\n" + "".join(f"ab{i % 10},x\n" for i in range(30)),
        "abc,xy\n" + "".join(f"ab{i % 10},zz\n" for i in range(30)),
        "name,when\n" + "".join(f"{'q' * (i % 4 + 1)},2024-01-{10 + i}\n" for i in range(15)),
    ],
)
def test_vote_agrees_with_the_standard_sniffer(spark, tmp_path, content):
    (tmp_path / "f.csv").write_text(content)
    row = profile.profile_files(spark, str(tmp_path)).first()
    assert row.has_header == csv.Sniffer().has_header(content)


def test_lines_stay_in_their_task(spark, folder):
    """Of a count, only rows of whole blocks are shuffled; of a profile, the text is scanned once."""
    lines = profile.read_lines(spark, str(folder))
    plan = profile.count_records(lines)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.rindex("MapInArrow") :]
    assert "Exchange" not in scan and "Window" not in scan and scan.count("FileScan text") == 1
    assert not re.search(r"\bvalue#", plan[: plan.rindex("MapInArrow")])
    shown = profile.profile_files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in shown  # it reads the folded blocks, which one scan has made


def test_an_unclosed_quote_is_found_out_in_linear_time(spark, tmp_path):
    import time

    (tmp_path / "open.csv").write_text('id,t\n1,"never closed\n' + "2,x\n" * 300_000)
    (tmp_path / "first.csv").write_text('id,"t\n' + "2,x\n" * 300_000)
    (tmp_path / "short.csv").write_text('id,"t\n2,x\n')
    start = time.time()
    got = by_name(profile.profile_files(spark, str(tmp_path)))
    assert time.time() - start < 60
    assert got["open.csv"].header == ["id", "t"] and got["open.csv"].readable and got["open.csv"].n_lines == 300_002
    assert got["first.csv"].header == [] and not got["first.csv"].readable
    assert got["short.csv"].readable and got["short.csv"].header == ["id", "t\n2,x"]


def test_folded_blocks_equal_lines_one_by_one():
    import numpy as np

    from trellium.operators.blocks import FLIP, SET_OUT, states

    rng = np.random.default_rng(4)
    for _ in range(300):
        actions = rng.integers(0, 4, rng.integers(1, 12)).astype(np.int8)
        for start, got in zip((0, 1), states(actions)):
            state, expected = start, []
            for a in actions:
                state = 1 - state if a == FLIP else int(a) - SET_OUT if a >= SET_OUT else state
                expected.append(state)
            assert got.tolist() == expected


def test_work_tables_are_deleted(spark, folder):
    import os

    from trellium.sources.folders import scratch, shared_base

    def kept():
        return {n for n in os.listdir(shared_base(spark)) if n.startswith(("blocks-", "heads-"))}

    before = kept()
    with scratch():
        assert profile.profile_files(spark, str(folder)).count() == 8
        assert kept() > before
    assert kept() == before


def test_many_parts_with_headers_only(spark, tmp_path):
    """Parts without rows, a part without the header, and few rows in each: the first records span files."""
    part = tmp_path / "d"
    part.mkdir()
    for i in range(60):
        (part / f"part-{i:02d}.csv").write_text("id,name\n" + (f"{i},x\n" if i % 7 == 3 else ""))
    (part / "part-60.csv").write_text("60,y\n61,\"a\nb\"\n")
    head = profile.first_records(profile.read_lines(spark, str(part)), 11, "folder", headers_in_parts=True).first()
    assert head.records == ["id,name", *[f"{i},x" for i in range(60) if i % 7 == 3], "60,y", '61,"a\nb"'][:11]
    plain = profile.first_records(profile.read_lines(spark, str(part)), 4, "folder").first()
    assert plain.records == ["id,name"] * 4
