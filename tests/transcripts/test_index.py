"""The search index against the scan: what patterns require, candidates, files read."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.operators import index, search

WORDS = ["Kelvin", "task", "TASK", "taſk", "Kelvin", "DİSK", "dısk", "straße", "STRASSE", "naïve", "NAÏVE", "foo.bar", "foo bar", "error:", "Error", "id=42", "a+b", "日本語テキスト", "日本", "x\ty", "(see", "note)", "end.", "abcabcabc"]
PATTERNS = [
    "task", "TASK", "kelvin", "disk", "DISK", "straße", "strasse", "naïve", "na.ve", "foo\\.bar", "foo.bar", "foo[. ]bar", "foo[^.]bar", "(foo|error)",
    "(?:foo|err)or", "err(or|or:)", "error:?", "erro+r", "er{2}or", "(abc){2,}", "(abc){3}", "(abc)?task", "(zzz)*task", "(zzz)+task", "id=\\d+", "\\bid=", "a\\+b", "a+b", "日本語", "日本",
    "日本語テ.スト", "x\\ty", "\\(see", "note\\)", "^task", "task$", "(?=task)task", "foo(?!\\.)", "(?<=foo)\\.bar", "(?i)error", "(?s)foo.bar", "[a-c]{3}abc", "[et]ask|[Kk]elvin", "\\x66oo", "\\u0066oo",
    "\\Qfoo.b\\E", "\\p{L}{4}in", "task|", "", "..", "kel(?<rest>vin)", "(task )++", "[\\w]ask", "[f]oo", "e(r|l)(r|v)(o|i)(r|n)", "zebra", "qqq|task zzz",
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = [("main", f"s{i % 7}", i, 0, " ".join(WORDS[(i * k + k * k) % len(WORDS)] for k in range(1, 2 + i % 5)), ["owner", "agent", None][i % 3]) for i in range(900)]
    rows += [("main", "s1", 5000, 0, None, "owner"), ("main", "s1", 5001, 0, "", "rare"), ("main", "s1", 5002, 0, "ab", "rare"), ("main", "s2", 10, 0, rows[10][4], "owner")]
    cut = "x" * (index.PIECE - 2)
    rows += [("main", "long", 0, 0, cut + "zebra" + "y" * 200_000, "owner"), ("main", "long", 1, 0, "x" * (index.PIECE - 4) + "zebra", "agent")]
    df = spark.createDataFrame(rows, "format string, session_id string, offset bigint, seq int, text string, kind string").repartition(3)
    index.build(df, path, tags=["kind"], files=6)
    return path, df.cache()


def rows_of(df):
    return sorted((r.session_id, r.offset, r.snippet) for r in df.collect())


def test_every_pattern_finds_what_the_scan_finds(spark, built):
    path, df = built
    each = lambda find: reduce(DataFrame.unionByName, (find(p).withColumn("p", F.lit(p)) for p in PATTERNS)).select("p", "session_id", "offset", "snippet")
    scan = sorted(map(tuple, each(lambda p: search.grep(df, p, 10)).collect()))
    assert sorted(map(tuple, each(lambda p: index.grep(spark, path, p, 10)).collect())) == scan
    assert len({p for p, *_ in scan if index.required(p) is not None}) > 30  # the index has a say in most


def test_tags_and_mentions(spark, built):
    path, df = built
    for kinds in (["owner"], ["rare"], ["owner", "agent"], ["none"]):
        for pattern in ("task", ".."):
            assert rows_of(index.grep(spark, path, pattern, 10, kind=kinds)) == rows_of(search.grep(df.filter(F.col("kind").isin(kinds)), pattern, 10))
    for needle in ("Kelvin", "TASK", "naïve", "日本語", "ze", "zebra", "no such"):
        assert sorted(map(tuple, index.mentions(spark, path, needle).collect())) == sorted(map(tuple, search.mentions(df, needle).collect())), needle


def test_only_files_with_candidates_are_read(spark, built):
    path, df = built
    files = lambda df: {f.rsplit("/", 1)[1] for f in df.inputFiles() if "/rows/" in f}
    everything = files(spark.read.parquet(f"{path}/rows"))
    assert len(everything) > 2
    assert files(index.grep(spark, path, "..")) == everything
    assert len(files(index.grep(spark, path, "zebra"))) == 1
    assert not files(index.grep(spark, path, "no such text"))
    blocks = index.candidates(spark, path, index.required("zebra")).count()
    assert blocks == 1


def test_requirements():
    need = lambda p: index.keys_of(index.required(p))
    assert need("abcd") == {"abc", "bcd"} and index.required("abcd")[0] == "and"
    assert index.required("abc|xyz") == ("or", ["abc", "xyz"]) and index.required("abc|x") is None
    assert index.required("abc.*xyz") == ("and", ["abc", "xyz"])
    assert need("ab[cd]") == {"abc", "abd"} and need("ab\\b c") == {"ab ", "b c"}
    assert index.required("(abc)*") is None and index.required("(abc)+") == "abc"
    assert index.required("[a[b]]abc") is None and index.required("\\Qabc\\E") is None and index.required("(?x)a b c") is None
    assert len(need("x".join(map(str, range(100, 200))))) <= index.PER_LITERAL + 1


def test_empty_and_clashing(spark, tmp_path):
    empty = spark.createDataFrame([], "format string, session_id string, offset bigint, seq int, text string")
    index.build(empty, f"{tmp_path}/empty")
    assert index.grep(spark, f"{tmp_path}/empty", "abc").count() == 0 and index.grep(spark, f"{tmp_path}/empty", ".").count() == 0
    with pytest.raises(ValueError, match="block"):
        index.build(empty.withColumn("block", F.lit(1)), f"{tmp_path}/no")
    with pytest.raises(ValueError, match="offset"):
        index.build(empty, f"{tmp_path}/no", tags=["offset"])
