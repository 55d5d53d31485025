"""Delimited files whose quotes hold line breaks: read in splits, with the rows of the unsplit reader."""

import random
from collections import Counter

import pytest

import cleanframe as cf
from cleanframe.sources.quoted import breaks_quotes, quoted_records


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "300")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def file_of(rng, sep, rows):
    pieces = ["x", "yy", '"', '""', sep, "\n", "\n\n", f'"{sep}"', "é日", " ", f"{sep}\n", '"\n"', "-"]
    lines = [sep.join(("id", quoted("two\nlines"), "c"))]
    for i in range(rows):
        kind = rng.random()
        value = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        if kind < 0.5:
            cells = [str(i), quoted(value), "z"]
        elif kind < 0.7:
            cells = [str(i), f'5" pipe, {i}'.replace(sep, ";"), quoted("a b")]
        elif kind < 0.75:
            cells = [str(i), quoted("long\n" * 200), quoted("")]
        elif kind < 0.8:
            cells = [str(i)]
        elif kind < 0.85 and sep == ",":
            cells = [str(i), "b", "c", quoted("too\nmany")]
        else:
            cells = [str(i), f"plain{i}", ""]
        lines.append(sep.join(cells))
    return "\n".join(lines) + ("\n" if rng.random() < 0.5 else "")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sep, end", [(",", "\n"), ("\t", "\n"), (",", "\r\n")])
def test_splits_have_the_rows_of_the_unsplit_reader(spark, small_splits, tmp_path, sep, end):
    rng = random.Random(len(sep + end))
    name = "t.csv" if sep == "," else "t.tsv"
    for k in range(2):
        folder = tmp_path / f"{k}-{name}"
        folder.mkdir()
        for part in range(2):
            (folder / f"{part}{name}").write_text(file_of(rng, sep, 120).replace("\n", end), newline="")
        path = f"{folder}/*{name}"
        split = cf.load(spark, path, infer=False)
        assert breaks_quotes(spark, path, sep)
        assert rows_of(split) == rows_of(cf.load(spark, path, infer=False, multiline=True))
        assert quoted_records(spark, path, sep).rdd.getNumPartitions() > 20
        assert dict(cf.load(spark, path).dtypes)["id"] == "bigint"


def test_a_stray_quote_changes_nothing(spark, small_splits, tmp_path):
    text = "id\tsize\n" + "".join(f"{i}\t{i} inch\n" for i in range(200)) + '200\t5" pipe\n' + "".join(f"{i}\t{i} inch\n" for i in range(201, 400))
    (tmp_path / "t.tsv").write_text(text)
    path = str(tmp_path / "t.tsv")
    assert not breaks_quotes(spark, path, "\t")
    df = cf.load(spark, path)
    assert df.rdd.getNumPartitions() > 3
    assert rows_of(df) == Counter((i, '5" pipe' if i == 200 else f"{i} inch") for i in range(400))


def test_a_quote_that_never_closes(spark, small_splits, tmp_path):
    text = 'a,b\n1,"x\ny"\n2,"open ' + "and so on\n" * 90 + "end"
    (tmp_path / "t.csv").write_text(text)
    got = cf.load(spark, str(tmp_path / "t.csv"), infer=False)
    assert rows_of(got) == Counter([("1", "x\ny"), ("2", "open " + "and so on\n" * 90 + "end")])


def test_a_record_over_many_splits_and_lines_of_quotes(spark, small_splits, tmp_path):
    long = "no quote here at all\n" * 100
    rows = [("1", long), ("2", '"'), ("3", '""\n"' + long + '"'), ("4", "\n"), ("5", ",")]
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i},{quoted(v)}\n" for i, v in rows))
    assert rows_of(cf.load(spark, str(tmp_path / "t.csv"), infer=False)) == Counter(rows)
