"""Implied trigrams are sound; searches of an index give the rows of full scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codesift.catalog.queries import SAVED_QUERY_ROWS
from codesift.catalog.patterns import PATTERN_ROWS
from codesift.operators import search, trigrams as tg


def holds(condition, text):
    if condition is True:
        return True
    if isinstance(condition, str):
        return condition in tg.fold(text)
    return (all if condition[0] == "and" else any)(holds(c, text) for c in condition[1])


ATOMS = ["a", "b", "abc", "x", "[ab]", "[^a]", ".", r"\d", "(?:ab|cde|)", "(abc|b)", "(?i:abc)", "é", "ſ", "İ", r"\b", "^", "$", "(?=abc)", "(?!b)"]


def test_any_match_holds_the_condition():
    rng = random.Random(2)
    checked = 0
    for _ in range(6000):
        pattern = "".join(rng.choice(ATOMS) + rng.choice(["", "", "", "?", "+", "*", "{2}", "{1,3}", "+?"]) for _ in range(rng.randrange(1, 7)))
        pattern = rng.choice(["", "", "(?i)"]) + pattern
        try:
            regex = re.compile(pattern)
        except re.error:
            continue
        condition = tg.condition_of(pattern)
        for _ in range(12):
            text = "".join(rng.choice("aabbccdexABCé1\nſİiK") for _ in range(rng.randrange(0, 25)))
            if regex.search(text):
                checked += 1
                assert holds(condition, text), (pattern, condition, text)
    assert checked > 5000


@pytest.mark.parametrize("pattern,want", [
    ("abcd", ("and", ("abc", "bcd"))), ("ab", True), ("a.cdef", ("and", ("cde", "def"))), (r"\d+", True), ("(?i)ABC", "abc"),
    ("abc|def", ("or", ("abc", "def"))), ("abc|d", True), ("[xy]ab", ("or", ("xab", "yab"))), ("(foo)+bar", ("and", ("foo", ("and", ("foo", "oob", "oba", "bar"))))),
    ("x(?:ab)*cde", "cde"), (r"[a-z&&[^b]]abc", True), (r"\Qabc\E", True), ("(?<n>abc)", True), ("", True), ("ab{2}c", ("and", ("abb", "bbc")))])
def test_condition_of(pattern, want):
    got = tg.condition_of(pattern)
    assert got == want or (want not in (True,) and tg.grams_in(got) == tg.grams_in(want) and got is not True)


def test_rarest_keeps_a_superset():
    counts = {"abc": 5, "bcd": 1, "cde": 9, "def": 2, "efg": 3}
    cut = tg.rarest(tg.condition_of("abcdefg"), counts)
    assert tg.grams_in(cut) == {"abc", "bcd", "def", "efg"}
    assert tg.rarest(True, {}) is True and tg.rarest("abc", {}) == "abc"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["eval", "exec", "(", ")", "x", "password", "=", "'abcdefghijklmnopqrs'", "os.system", "\n", " ", "MD5", "Ünïcode", "pickle.loads", "İ", "ﬀ"]
    rows = [(i, f"d{i % 7}/f{i}.py", "".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(300, "long.py", "z" * 200_000 + "eval(1)"), (301, "none.py", None), (302, "two.js", "eval(2)")]
    files = spark.createDataFrame(rows, "file_id long, path string, text string").withColumns(
        {"ext": F.lit(".py"), "size": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    index = tg.write_index(files, str(tmp_path_factory.mktemp("index") / "i"), 5000)
    return files, index


def plain(df):
    return sorted(map(str, df.drop("context_rows").collect()))


def test_saved_queries_on_an_index(corpus):
    files, index = corpus
    assert plain(search.run_query_on_index(index)) == plain(search.run_query(files))
    for row in SAVED_QUERY_ROWS:
        assert plain(search.run_query_on_index(index, row[0])) == plain(search.run_query(files, row[0]))


@pytest.mark.parametrize("pattern", [r"eval\(2\)", r"(?i)md5", "ünïcode", r"\d", "zzzeval", "nowhere at all", "^x", "İ.?İ", "ﬀx"])
def test_ad_hoc_searches(corpus, pattern):
    files, index = corpus
    assert plain(search.search_index(index, pattern)) == plain(search.search_pattern(files, pattern))


def test_a_search_reads_the_blocks_of_its_candidates(corpus):
    files, index = corpus
    found = tg.candidate_files(index, [r"zzzeval\("])
    assert [r["path"] for r in found.select("path").collect()] == ["long.py"]
    everything = {p.rsplit("block=", 1)[1].split("/")[0] for p in index.texts.inputFiles()}
    block = index.texts.where("path = 'long.py'").first()["block"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # One folder of many is read.
    assert re.search(rf"PartitionFilters: \[[^\]]*block#\d+ = {block}\)?\]", plan) and len(everything) > 20
    cost = tg.search_cost(index, r"zzzeval\(").first()
    assert (cost["candidates"], cost["candidate_bytes"], cost["files"], cost["indexed"]) == (1, 200_007, 303, True)
    assert tg.search_cost(index, r"\d").first()["candidates"] == 303
    assert tg.search_cost(index, "no such thing").first()["candidates"] == 0


def test_pattern_catalogue_can_be_indexed():
    # Most rules of the catalogue imply something; none is misread as an error.
    implied = [tg.condition_of(row[2]) for row in PATTERN_ROWS]
    assert sum(c is not True for c in implied) > len(implied) / 2


def test_hot_trigrams_have_bounded_rows(spark, tmp_path):
    files = spark.range(2000).selectExpr("id AS file_id", "concat('f', id) AS path", "3L AS size", "'the same' AS text")
    index = tg.write_index(files, str(tmp_path / "i"), 600)
    rows = index.postings.selectExpr("gram", "block", "size(files) AS n").collect()
    assert len({r["block"] for r in rows}) == 10 and sum(r["n"] for r in rows) == 2000 * 6 and max(r["n"] for r in rows) < 400


def test_costs_open_no_block(corpus):
    _, index = corpus
    for pattern in (r"zzzeval\(", r"\d"):
        read = tg.search_cost(index, pattern).inputFiles()
        assert read and not any("/texts/" in f for f in read)
    assert index.texts is index.texts and index.sizes.count() == 303
