"""CSV lines taken in runs, in few tasks, and imported in one pass."""

import random

import pytest

from ledgerspark.sources import exports, headers

HEAD = "Invoice,Vendor,Date,Amount"


@pytest.mark.parametrize("delimiter", exports.DELIMITERS)
@pytest.mark.parametrize("state", [exports.BETWEEN, exports.INSIDE])
def test_runs_of_lines_are_as_line_by_line(delimiter, state):
    rng = random.Random(ord(delimiter) + state)
    parts = [b"a", b'"', b'"', b'""', b"\r", b",", b";", b"\t", b" ", b""]
    for _ in range(400):
        lines = [b"".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(6)]
        want, now = [], state
        for line in lines:
            now, *rest = exports.after_line(line, ord(delimiter), now)
            want.append((now, *rest))
        at = 0
        for n, *got in exports._runs(lines, ord(delimiter), state):
            own = want[at : at + n]
            starts, sound = sum(w[1] for w in own), all(w[3] for w in own)
            assert got == [own[-1][0], starts, own[-1][2], sound]
            at += n
        assert at == len(lines)


def test_plain_lines_are_one_run():
    lines = [b'"a","b ""c""",d', b"", b'x"y,z\r', b'"q"'] * 500
    assert [n for n, *_ in exports._runs(lines, ord(","), exports.BETWEEN)] == [2000]


def test_small_splits_share_tasks(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text(HEAD + "\n" + "".join(f'"i{k}",v,2024-01-02,{k}\n' for k in range(3000)))
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        splits = spark.read.text(str(path)).rdd.getNumPartitions()
        cells = exports.read_csv_exports(spark, [str(path)])
        tasks = cells.rdd.getNumPartitions()
        rows = headers.map_headers(cells).or_fail().select("invoice_raw").collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert splits > 200 and tasks < splits / 4
    assert sorted(r[0] for r in rows) == sorted(f"i{k}" for k in range(3000))


@pytest.mark.parametrize("mode", ["strict", "words"])
def test_rows_are_written_and_decided_in_one_pass(spark, tmp_path, mode):
    path = tmp_path / "one.csv"
    path.write_text(HEAD + "\ni1,v,2024-01-02,5\ni2,w,2024-01-03,6\n")
    intake = headers.map_headers(exports.read_csv_exports(spark, [str(path)]), mode=mode)
    stored = intake.or_fail(str(tmp_path / "rows"))
    assert sorted(stored.collect()) == sorted(intake.or_fail().collect())
    # read from there, not from the export
    assert all(str(tmp_path / "rows") in f for f in stored.inputFiles())


@pytest.mark.parametrize("text", ['Invoice,Vendor\ni1,v\n', HEAD + '\n"i1,v,2024-01-02,5\n', HEAD + "\n"])
def test_one_pass_refuses_what_the_other_refuses(spark, tmp_path, text):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    intake = headers.map_headers(exports.read_csv_exports(spark, [str(path)]))
    with pytest.raises(ValueError) as plain:
        intake.or_fail()
    with pytest.raises(ValueError) as stored:
        intake.or_fail(str(tmp_path / "rows"))
    assert str(stored.value) == str(plain.value)
