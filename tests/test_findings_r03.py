"""Rows and sizes on which queries failed."""

import datetime
import random
import re
import time
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_whole import tables

from proofmill import catalogue, catalogue_filings, catalogue_findings  # noqa: F401
from proofmill.functions import guards, names
from proofmill.llm import line_dedup, mixing, near_join
from proofmill.operators import extraction, matching, sections, vendors
from proofmill.sources import replay
from proofmill.streaming import journal


def same_as_sql(spark, sf, name, *read):
    duck = duckdb.connect()
    for t in read:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted(want, key=str)
    return rows


@pytest.mark.parametrize("name", ["settled_answers", "analyst_scores"])
def test_supplier_of_the_notes_number(spark, tmp_path, name):
    items = [(7 * k, 5, s, n, 10.0, 1.0) for k in (1, 2, 3) for n, s in ((1, 2023 + k), (2, 30))]
    sf = tables(spark, tmp_path, lineitem=(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"))
    assert same_as_sql(spark, sf, name, "lineitem")


@pytest.mark.parametrize("name", ["settled_answers", "analyst_scores", "card_answers"])
def test_cards_of_many_lines_and_long_numbers(spark, tmp_path, name):
    """A card may have 99 lines and more; a supplier's number may be as long as a telephone's, or with what a reply puts before it."""
    items = [(k, n, 30 + n, n % 7 + 1, float(n % 50), 1.0) for k in range(700, 714) for n in range(130)]
    items += [(k, 5, s + k, n, 10.0, 1.0) for s in (10**8, 710**3, 9 * 10**9, 91 * 10**10) for k in range(s, s + 14) for n in (1, 2)[: k % 2 + 1]]
    sf = tables(spark, tmp_path, lineitem=(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"))
    same_as_sql(spark, sf, name, "lineitem")


def scored(a, b):
    return 2 * names._lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def spelled(r, n, alphabet, lengths):
    out = ["".join(r.choices(alphabet, k=r.choice(lengths))) for _ in range(n)]
    return list(dict.fromkeys(out + [t[:k] + r.choice(alphabet) + t[k + r.randrange(3) :] for t in out for k in [r.randrange(len(t) + 1)]]))


@pytest.mark.parametrize("lengths", [[5, 6, 8], [12, 15, 16], [31, 32], [60, 64, 65, 90], [0, 3, 40, 300]])
def test_near_in_blocks(monkeypatch, lengths):
    r = random.Random(str(lengths))
    xs, ys = ([t for t in spelled(r, 40, alphabet, lengths)] for alphabet in ("ab 1", "ab é"))
    ys += [t for t in xs[::3] if t not in ys]
    for cells in (50, 1 << 18):
        monkeypatch.setattr(matching, "CELLS", cells)
        for left, right, once in ((xs, ys, False), (xs, xs, True)):
            got = [(a, b, c) for i, j, s in matching._near(left, right, 0.85, once) for a, b, c in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)]
            want = [(i, j, s) for i, a in enumerate(left) for j, b in enumerate(right) if (i <= j or not once) and (s := scored(a, b)) >= 0.85]
            assert sorted(got) == want and want


def test_best_of_many_blocks(spark, monkeypatch):
    """The best of a group whose keys lie in several blocks, the smallest number of equals."""
    monkeypatch.setattr(matching, "BLOCK", 7)
    r = random.Random(5)
    keys = [(g, t, 1000 - i) for g in "uv" for i, t in enumerate(spelled(r, 30, "abc", [9, 10, 11]))]
    asked = [(g, t, i) for g in "uvw" for i, t in enumerate(spelled(r, 12, "abc", [9, 10, 11]))]
    frame = lambda rows: spark.createDataFrame(rows, "g string, key string, n long")
    want = {(g, i): max((scored(t, k), -n) for h, k, n in keys if h == g) for g, t, i in asked if g != "w"}
    got = matching.alike(frame(asked), frame(keys), "g", 0.7, by="n", best=True).collect()
    assert sorted((x.g, x.a, x.score, x.b) for x in got) == sorted((g, i, s, -n) for (g, i), (s, n) in want.items() if s >= 0.7)


def test_copies_of_names(spark, tmp_path):
    """Customers of a name that recurs have its class, and a row each: they are not paired."""
    rows = [(i, f"Customer {'abcdef'[i % 6] * 9}", i % 2) for i in range(6000)]
    sf = tables(spark, tmp_path, customer=(rows, "c_custkey long, c_name string, c_nationkey int"))
    got = [tuple(x) for x in catalogue.QUERIES["name_similarity"](spark, sf).collect()]
    assert sorted(got) == [(i, i % 6, 0, 999) for i in range(6000)]


@pytest.mark.parametrize("few", [0, 1024])
def test_links_are_counted_in_blocks(spark, monkeypatch, few):
    """Links of keys in several blocks, with what their keys weigh; also of keys that all begin and end alike."""
    monkeypatch.setattr(matching, "BLOCK", 20)
    monkeypatch.setattr(matching, "FEW", few)
    r = random.Random(6)
    keys = [(g, f"x{t} customer", i, r.randrange(1, 9)) for g in "uv" for i, t in enumerate(spelled(r, 40, "abc", [5, 6, 7]))]
    near = {(g, i): [(j, w) for h, u, j, w in keys if g == h and i != j and scored(t, u) >= 0.85] for g, t, i, _ in keys}
    got = matching.links(spark.createDataFrame(keys, "g string, key string, n_ long, w long"), "g", 0.85, "n_", "w").collect()
    assert {(x.g, x.n_): (x.n, x.w) for x in got} == {k: (len(v), sum(w for _, w in v)) for k, v in near.items() if v}
    assert len(got) == len({(x.g, x.n_) for x in got}) > 100


def test_many_names_of_few_letters(spark):
    """Names that all share their letters: what their letters' blocks hold in common must not be joined pair by pair."""
    name = F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop")
    keys = spark.range(14_000).select(F.lit(1).alias("g"), name.alias("key"))
    began = time.time()
    cut = keys.select("g", F.left("key", F.lit(30)).alias("key"))
    assert matching.alike(keys, cut, "g", 0.85).count() == 14_000
    assert time.time() - began < 60


@pytest.mark.parametrize("name", ["replay_stream", "replay_bundles"])
def test_bundles_of_many_cases(spark, tmp_path, name):
    """More cases than get folders of their own share files, few whatever their number."""
    rows = [(i, datetime.datetime(2024, 1, 1), i % 900, "view", 1.0, '{"k": 1}') for i in range(1800)]
    sf = tables(spark, tmp_path / "in", events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    homes = []
    written = replay.write_bundles
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(replay, "write_bundles", lambda events, cards, case, home: (homes.append(home), written(events, cards, case, home)))
        assert len(same_as_sql(spark, sf, name, "events")) == (720 if name == "replay_stream" else 1440)
    assert all(len(spark.read.text(f"{homes[0]}/{part}").inputFiles()) < 100 for part in ("events", "cards"))


def test_lines_of_pages_are_cut_once(spark, tmp_path):
    """A map reads the stored lines, not the pages again for each of its steps."""
    pages = [(1, 1, "CONTENTS\nRISK FACTORS .... 2\nOUR PROMOTERS .... 3"), (1, 2, "Risk factors"), (1, 3, "Page 3\nOur Promoters")]
    spark.createDataFrame(pages, "d int, page int, text string").write.parquet(f"{tmp_path}/p")
    found = sections.section_map(spark.read.parquet(f"{tmp_path}/p"), "d")
    assert [(r.section, r.start, r.end) for r in found.collect()] == [("promoters", 3, 3)]
    assert all("page-lines" in f for f in found.inputFiles())


def test_cases_of_paths(spark, tmp_path):
    """A line's case comes from its path's last parts; no pattern runs over whole paths."""
    line = '{"v":1,"id":"s-1","scan":"s","t_ns":1,"type":"x","data":"{}"}'
    at = ["case=a b/part-0", "c/events.jsonl", "d/events.jsonl/part-0", "case=x/y/part-0", "case=/part-0", "part-0"]
    for i, p in enumerate(at):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(line if i < 3 else f"t{i}\t{line}")
    read = replay.read_bundles(spark, str(tmp_path))
    assert sorted((r.case, r.rule) for r in read.collect()) == [("a b", None), ("c", None), ("d", None), ("t3", None), ("t4", None), ("t5", None)]
    assert "regexp" not in read._jdf.queryExecution().optimizedPlan().toString().lower()


def test_checked_numbers_need_no_python(spark):
    """Long texts aren't sent to Python to have their numbers checked; what is masked stays the same."""
    r, pattern = random.Random(7), re.compile(guards.AADHAAR, re.ASCII)
    fine = lambda: (lambda d: d + str(guards.check_digit(d)))(str(r.randrange(2, 10)) + "".join(r.choices("0123456789", k=10)))
    cut = lambda d: r.choice([d, f"{d[:4]} {d[4:8]} {d[8:]}", f"{d[:4]}-{d[4:8]}-{d[8:]}"])
    other = lambda: r.choice(["", " ", "x", "7", "é", "\n", "3333 ", " 4567", "$1"])
    texts = [None, "", "none"] + ["".join(other() + r.choice([cut(fine()), "2345 6789 0123"]) + other() for _ in range(r.randrange(1, 5))) for _ in range(300)]
    texts += [f"{n} 9{n} {n}8" for n in (fine() for _ in range(20))]
    want = [t and pattern.sub(lambda m: "[aadhaar]" if guards.verhoeff(re.sub(r"\D", "", m[0])) == 0 else m[0], t) for t in texts]
    got = spark.createDataFrame([*enumerate(texts)], "i long, t string").select("i", guards.mask_aadhaar(F.col("t")).alias("t"))
    assert [x.t for x in got.orderBy("i").collect()] == want and any(t and "[aadhaar]" in t for t in want)
    assert "Python" not in spark.range(1).select(guards.mask_pii(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()


def test_hits_are_normalized_once(spark):
    """What follows reads the stored hits that name a subject, not the documents again."""
    for name in ("litigation_matters", "litigation_status"):
        found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert found.count() and not any("documents" in f for f in found.inputFiles())


def test_values_of_claims_are_normalized_together(spark):
    """A claim's values go to Python once, not each by itself, and pages are dealt to as many tasks as shuffles have."""
    pages = spark.createDataFrame([(1, 1, "promoters", "Our Promoters are Asha Rao and Ravi Shah"), (1, 2, "none", "x")], "d int, p int, s string, t string")
    found = extraction.extracted(pages, "d", "p", "s", "t")
    assert sorted((r.name, r.verdict) for r in found.collect()) == [("Asha Rao", "kept"), ("Ravi Shah", "kept")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_folded(") <= 4 and "RepartitionByExpression [doc" in plan


def test_calls_of_a_missing_key():
    """A key that is asked for first has no timers to list, and one that stays missing changes nothing."""
    calls, now = [], {}
    until = SimpleNamespace(get=lambda: now.get("until"), update=lambda v: (calls.append("update"), now.update(until=v)))
    handle = SimpleNamespace(getValueState=lambda *a: until, listTimers=lambda: calls.append("list") or [], registerTimer=lambda t: calls.append("register"))
    cache = journal.NegativeCache("k", 1000)
    cache.init(handle)
    at = lambda *micros: iter([pd.DataFrame({"k": "a", "event_id": range(len(micros)), "at": pd.to_datetime(list(micros), unit="us")})])
    told = [o for batch in (at(900, 5, 2000), at(2100)) for out in cache.handleInputRows(("a",), batch, None) for o in out["outcome"]]
    assert told == ["fetch", "missing", "fetch", "missing"] and calls == ["update", "register"]


def test_stages_shuffle_texts_at_any_size(spark, monkeypatch):
    """Small tables take the joins of large ones, so that disk is in proportion; the mix stores no texts of its own. Rows
    that repeat are taken as often as ``mix`` has it."""
    rows = [(None if i % 50 == 0 else i // 3, f"{'word ' * (i // 3 % 9)}{i // 3}", f"s{i // 3 % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.create_map("source", "doc_id"))
    stored, of = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name, *a: stored.append((name, df.columns)) or of(df, name, *a))
    got = mixing.mixed(docs)
    assert not any({"doc", "text"} & set(columns) for _, columns in stored)
    sums = lambda d, n: {(x.doc_id, x.size, x.source_size): x.n for x in d.groupBy("doc_id", "size", "source_size").agg(n.alias("n")).collect() if x.n}
    sizes = mixing.mix(docs).select("source_size", "target", "doc_id", "size", "copies")
    size = F.size(F.split("text", " ")).cast("long").alias("size")
    of_source = {s: sum(len(t.split()) for _, t, u in rows if u == s) for s in {r[2] for r in rows}}
    told = got.select("doc_id", size, F.create_map(*[F.lit(x) for kv in of_source.items() for x in kv])[F.col("source")].alias("source_size"))
    assert got.columns == docs.columns and sums(told, F.count("*")) == sums(sizes, F.sum("copies"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("SortMergeJoin")[0]
    seen = []
    monkeypatch.setattr(near_join, "_buckets", lambda d, *a: seen.append(d._jdf.queryExecution().executedPlan().toString()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        near_join.join(docs.select("doc_id", "text"))
    assert "SortMergeJoin" in seen[0]


def test_pages_meet_their_own_vendor_alone(spark, monkeypatch):
    """vendor_second_pass: a page is held against the vendor that it was searched for, without an index of grams over all
    pages, and tells of it what named_pages does."""
    who = [(1, "Oasis Corpcare Private Limited"), (2, "Acme Steel Pvt. Ltd."), (3, "Limited"), (4, None), (5, "Unseen Ltd")]
    told = [(1, 1, "OASIS CORPCARE PRIVATE LIMITED - x", None), (2, 1, "Profile", "of OASIS CORPCARE PVT LTD, Mumbai"), (3, 1, "Acme Steel", "Acme Steel"), (4, 2, "Steel Acme Limited", "x"), (5, 2, None, None), (6, 3, "Limited", "limited"), (7, 4, "None", "null"), (8, 6, "Acme", "Acme"), (9, 2, "x", "acmé acme steels"), (9, 2, "y", "")]
    v = spark.createDataFrame(who, "v int, name string")
    p = spark.createDataFrame(told, "page int, v int, title string, snippet string")
    got = sorted(map(tuple, vendors.own_pages(v, p, "v", "page").collect()))
    assert got == [(1, 1), (1, 2), (2, 4), (2, 9)] == sorted(map(tuple, vendors.named_pages(v.withColumn("g", F.col("v")), p.withColumn("g", F.col("v")), "v", "page", "g").collect()))
    monkeypatch.setattr(vendors, "containing", None)
    pages = p.withColumns({"look": F.lit(1), "place": F.lit(None).cast("string"), "url": F.concat(F.lit("https://www.tofler.in/"), "page")})
    found = {r.v: r.matched for r in vendors.vendor_facts(v, pages, "v", "page", "page").collect()}
    assert {k: len(m or []) for k, m in found.items()} == {1: 2, 2: 3, 3: 0, 4: 0, 5: 0}


def test_texts_are_shuffled_at_any_size(spark, monkeypatch):
    """lines and near_duplicates of pipeline: joins of texts aren't broadcast over little and shuffled over more, and entries
    are made of a part of the texts at a time."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} {'x' * (i % 7)}\na line of many sources\n{i}", f"s{i % 12}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert "SortMergeJoin" in line_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    seen, of = [], near_join.written
    monkeypatch.setattr(near_join, "written", lambda df, name, *a: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or of(df, name, *a))
    got = near_join.join(docs.select("doc_id", "text"))
    assert {r.component_id for r in got.collect()} == {0}
    assert len([1 for n, _ in seen if n == "entries"]) == near_join.SLICES
    assert next(p for n, p in seen if n == "links").count("SortMergeJoin") >= 2


def test_ascii_names_stay_out_of_python(spark, monkeypatch):
    """largest_quotes: NFKC is asked for names alone that it may change."""
    rows = spark.createDataFrame([("Acme Ltd",), ("Ａｃｍé Ltd",), (None,), ("",)], "name string")
    assert [r.n for r in rows.select(names.normalize_company(F.col("name")).alias("n")).collect()] == ["acme", "acm", None, ""]
    monkeypatch.setattr(names.F, "pandas_udf", lambda f, kind: lambda text: F.coalesce(F.concat(F.lit("asked "), text), F.lit(None).cast("string")))
    assert [r.n for r in rows.select(names.nfkc(F.col("name")).alias("n")).collect()] == ["Acme Ltd", "asked Ａｃｍé Ltd", None, ""]
