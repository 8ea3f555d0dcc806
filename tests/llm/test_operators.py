"""Each operator against a brute-force version, over documents with edge cases."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loadflow.llm import line_rules, mixing, quality_qda, secret_scan, sharding, simhash, substring, topk_bitslice

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def multiset(df_rows):
    return Counter(map(tuple, df_rows))


# Mixing


def water(sizes, weights=(5, 2, 1)):
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % 3] for i, k in enumerate(keys)}
    free, target, left = {k for k in keys if sizes[k]}, {k: 0.0 for k in keys}, sum(sizes.values())
    while free:
        unit = left / sum(weight[k] for k in free)
        over = {k for k in free if unit * weight[k] > 3 * sizes[k]}
        for k in over or free:
            target[k] = 3.0 * sizes[k] if over else unit * weight[k]
        if not over:
            break
        left -= sum(target[k] for k in over)
        free -= over
    return target


def test_mix_meets_targets_and_bounds(docs, rows):
    got = mixing.taken(docs, length=32, shard_slots=512).collect()
    again = mixing.taken(docs.repartition(7), length=32, shard_slots=512).collect()
    assert multiset(got) == multiset(again)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len(words(r["text"]))) for r in rows)
    target, taken = water(sizes), defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 33


def test_mixed_texts_hold_what_is_taken(docs):
    got = mixing.mix_documents(docs, length=32, shard_slots=512)
    assert got.columns == docs.columns
    taken = {r["doc_id"]: r["n"] for r in mixing.taken(docs, length=32, shard_slots=512).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    found = defaultdict(int)
    for r in got.select("doc_id", "text").collect():
        found[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in taken.items() if v}


def test_mix_shards_cover_every_slot_once(docs):
    _, spans, sources = mixing.mixed(docs, length=32, shard_slots=100)
    slots = spans.select("shard", "key", "round", "block").distinct()
    assert slots.groupBy("key", "round", "block").count().where("count > 1").count() == 0
    n = {r["key"]: r["n"] for r in slots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {r["key"]: r["slots"] for r in sources.table.collect() if r["slots"]} and sum(n.values()) == sources.slots
    assert max(r["n"] for r in slots.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()) == 100


def test_taken_follows_the_spans_of_the_mix(docs, rows):
    """Streams, blocks, rounds and cuts in plain Python; only where a document stands in its source's stream comes from the operator."""
    length = 32
    measured, spans, sources = mixing.mixed(docs.select("doc_id", "source", "text"), length=length, shard_slots=512)
    at = defaultdict(list)
    placed = mixing.streams(measured.select("rid", "key", "size", "hash", F.col("row.doc_id").alias("doc_id")), ["doc_id", "hash"], sources.rows).collect()
    for r in placed:
        at[r["key"]].append((r["begin"], r["size"], r["rid"]))
    names = {"1" if r["source"] is None else "0" + r["source"]: r["source"] for r in rows}
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    target, want = water(size), Counter()
    for key, own in at.items():
        n, due, stream = size[names[key]], round(target[names[key]]), []
        for begin, m, rid in sorted(own, key=lambda x: (x[0], x[1] > 0)):
            assert begin == len(stream)
            stream += [rid] * m
        assert len(stream) == n
        got = [(r["round"], r["block"]) for r in spans.where(F.col("key") == key).select("round", "block").distinct().collect()]
        n_blocks = -(-n // length)
        whole, rest = divmod(due, n) if n else (0, 0)
        assert {g for g in got if g[0] < whole} == {(i, b) for i in range(whole) for b in range(n_blocks)}
        assert len({b for i, b in got if i == whole}) == -(-rest // length) and all(i <= whole for i, _ in got)
        for i, b in got:
            for rid in stream[b * length : (b + 1) * length]:
                want[rid] += 1
        if rest % length:  # one block of the last round is cut, at its end
            seen = Counter({r["rid"]: r["n"] for r in spans.where((F.col("key") == key) & (F.col("round") == whole)).groupBy("rid").agg(F.sum(F.col("high") - F.col("low")).alias("n")).collect()})
            full = Counter(rid for i, b in got if i == whole for rid in stream[b * length : (b + 1) * length])
            cuts = [(b, w) for i, b in got if i == whole for w in [stream[b * length : (b + 1) * length]] if full - Counter(w[rest % length :]) == seen]
            assert cuts
            want -= Counter(cuts[0][1][rest % length :])
    ids = {r["rid"]: (r["row"]["doc_id"], r["row"]["source"]) for r in measured.collect()}
    taken = mixing.taken(docs, length=length, shard_slots=512).collect()
    assert Counter((r["doc_id"], r["source"], r["taken"]) for r in taken) == Counter((*ids[rid], want[rid]) for rid in ids)


@pytest.mark.parametrize("few", [10_000, 0])
def test_mix_of_many_sources(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", few)
    df = spark.range(20_000 if few else 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("https://host"), F.col("id") % (10_001 if few else 701)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"))
    df = df.unionByName(spark.range(500).select((F.col("id") + 100_000).alias("doc_id"), F.lit("big").alias("source"), F.repeat(F.lit("x "), 50).alias("text")))
    got = mixing.taken(df, length=8, shard_slots=1000).collect()
    size, taken = Counter(), Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    target = water(size)
    assert len(size) == (10_002 if few else 702) and all(abs(taken[s] - t) <= 8 for s, t in target.items())
    assert all(r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] for r in got)


def test_few_and_many_sources_give_one_mix(docs, monkeypatch):
    few = mixing.taken(docs, length=32, shard_slots=512).collect()
    monkeypatch.setattr(mixing, "FEW", 0)
    assert multiset(few) == multiset(mixing.taken(docs, length=32, shard_slots=512).collect())


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_permutation(spark, size):
    got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), [F.lit(7)]).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(size))


def test_no_word_at_all(docs, empty):
    assert mixing.taken(empty).count() == 0
    assert [r["taken"] for r in mixing.taken(docs.where("text is null")).collect()] == [0, 0]


# Secrets

KINDS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    out = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return sorted(out)


def test_base_spans(docs, rows):
    want = Counter()
    for r in rows:
        s = base_spans(r["text"])
        c = Counter(x[2] for x in s)
        want[r["doc_id"], c["assign"], c["access"], c["hex"], hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in s).encode()).hexdigest()] += 1
    got = secret_scan.digest(docs)
    assert multiset(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()) == want
    for r in got.collect():
        assert not r["n_assign"] or "assign:" in r["spans"]


def test_short_match_hides_what_it_covers(spark):
    texts = ["secret=token: abcdefgh", "token==abcdef", "API_KEY = 'abc.def'", "tokenpassword:abcdef"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.digest(df).collect()}
    assert got == {i: ",".join(f"{n}:{a}:{b}" for a, _, n, b in base_spans(t)) for i, t in enumerate(texts)}


def test_copied_values_are_examples_and_own_ones_live(spark):
    data = [(i, "password=ExampleKey123" + " ." * i, f"src{i % 4}") for i in range(8)] + [(10, "password=Own1Secret9x", "src1"), (11, "password=wordsonly", "src1"), (12, "see Zx81LoneToken99value77 here", "src2")]
    data += [(20 + i, "see Zx82LoneToken99value77 here" + " ." * i, f"src{i}") for i in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secret_scan.digest(df).collect()}
    assert (got[0]["n_example"], got[0]["n_live"]) == (1, 0)
    assert (got[10]["n_example"], got[10]["n_live"]) == (0, 1)
    assert (got[11]["n_example"], got[11]["n_live"]) == (0, 0)
    assert got[12]["spans"] == "owned:4:26" and got[20]["spans"] == ""
    red = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert red[10] == "[SECRET]" and red[3] == "password=ExampleKey123 . . ." and red[12] == "see [SECRET] here"
    assert secret_scan.digest(df.where("false")).count() == 0


def test_copies_of_a_text_are_one_repository(spark):
    data = [(i, "password=Own1Secret9x", f"src{i % 4}") for i in range(50)] + [(100, "token: Two2Owners8zz a", "src1"), (101, "token: Two2Owners8zz b", None), (102, "token: Two2Owners8zz b", "src2")]
    data += [(200 + i, f"token: Often3Seen7qq {i}", "src1") for i in range(21)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_live"], r["n_example"]) for r in secret_scan.digest(df).collect()}
    assert {got[i] for i in range(50)} == {(1, 0)} and {got[i] for i in (100, 101, 102)} == {(1, 0)} and {got[200 + i] for i in range(21)} == {(0, 1)}


def test_many_matches_in_one_text(spark):
    """Positions, spans that touch others, and redaction against plain Python, with more matches than a square would bear."""
    value = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    text = "é👍 " + "\n".join([f"{value(i)}" if i % 3 else f"x token={value(i)}/Ab+{value(i).upper()} AKIA{value(i).upper()}é" for i in range(20_000)])
    df = spark.createDataFrame([(1, text, "s", len(text)), (2, "", "s", 0)], "doc_id long, text string, source string, n_chars long")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secret_scan.digest(df).collect()}
    base = base_spans(text)
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in base).encode()).hexdigest()
    spans = [s.split(":") for s in got[1]["spans"].split(",")]
    assert [(int(a), int(b)) for n, a, b in spans if n != "owned"] == [(a, b) for a, _, _, b in base]
    red = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}[1]
    want, at = "", 0
    for _, a, b in spans:
        if int(a) >= at:
            want += text[at : int(a)] + "[SECRET]"
        at = max(at, int(b))
    assert red == want + text[at:] and time.perf_counter() - began < 90


def test_loose_spans_that_touch_no_base_span(spark):
    rng = np.random.default_rng(4)
    span = lambda a, n: {"start": int(a), "rank": 0, "kind": "k", "stop": int(a + n), "value": "v"}
    data = []
    for i in range(60):
        base = sorted((span(a, n) for a, n in zip(rng.integers(0, 200, i % 9), rng.integers(1, 40, i % 9))), key=lambda s: (s["start"], s["stop"]))
        at = np.sort(rng.choice(200, 2 * (i % 7), replace=False)).reshape(-1, 2)
        data.append((i, base, [span(a, b - a) for a, b in at]))
    df = spark.createDataFrame(data, f"i int, base {secret_scan._SPANS}, loose {secret_scan._SPANS}")
    got = {r["i"]: [(s["start"], s["stop"]) for s in r["free"]] for r in df.select("i", secret_scan.apart(F.col("loose"), F.col("base")).alias("free")).collect()}
    for i, base, loose in data:
        assert sorted(got[i]) == [(s["start"], s["stop"]) for s in loose if not any(b["start"] < s["stop"] and s["start"] < b["stop"] for b in base)]


# Sharding


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_shards(docs, rows, n_shards):
    got = sharding.digest(docs, n_shards).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len(raw(r["text"])) + 1, zlib.crc32(raw(r["text"]))) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(n_shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_by_bytes(docs):
    got = sharding.shard(docs.where("doc_id < 900000"), 4, "bytes").collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    most = max(r["size"] for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * most
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_few_rows(docs, empty):
    assert sharding.digest(empty).count() == 0
    assert sorted(r["slot"] for r in sharding.digest(docs.limit(3)).collect()) == [0, 0, 0]


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 3), (4, 2)])
def test_curve_steps_to_neighbours(spark, n, bits):
    df = spark.range(1 << (n * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"p{i}") for i in range(n)])
    path = df.withColumn("h", sharding.curve_index([F.col(f"p{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in path] == list(range(1 << (n * bits)))
    points = np.array([[r[f"p{i}"] for i in range(n)] for r in path])
    assert set(np.abs(np.diff(points, axis=0)).sum(axis=1)) == {1}


def test_rows_follow_the_curve(spark, docs, rows):
    """Cells by counting, and the place of each cell on the curve; the order of shards and slots is that of the curve."""
    got = sharding.shard(docs, 5, keep=["doc_id", "source", "lang", "text"]).collect()
    values = {(r["doc_id"], r["source"], r["lang"], r["text"]): None for r in rows}
    dims = [[v[1] and v[1].encode() for v in values], [v[2] and v[2].encode() for v in values], [v[0] for v in values], [len((v[3] or "").encode()) + 1 for v in values]]
    every = [[f(r) for r in rows] for f in (lambda r: r["source"] and r["source"].encode(), lambda r: r["lang"] and r["lang"].encode(), lambda r: r["doc_id"], lambda r: len((r["text"] or "").encode()) + 1)]
    where = {}
    for k, v in enumerate(values):
        where[v] = tuple(0 if d[k] is None else (2 * sum(x is None or x < d[k] for x in e) + sum(x == d[k] for x in e)) * 16 // (2 * len(rows)) for d, e in zip(dims, every))
    grid = spark.range(1 << 16).select(*[F.shiftright("id", 4 * i).bitwiseAND(F.lit(15)).cast("int").alias(f"p{i}") for i in range(4)])
    index = {(r["p0"], r["p1"], r["p2"], r["p3"]): r["h"] for r in grid.withColumn("h", sharding.curve_index([F.col(f"p{i}") for i in range(4)], 4)).collect()}
    path = np.array([p for p, _ in sorted(index.items(), key=lambda x: x[1])])
    assert set(np.abs(np.diff(path, axis=0)).sum(axis=1)) == {1}
    for r in got:
        x = r["row"]
        assert r["cell"] == index[where[x["doc_id"], x["source"], x["lang"], x["text"]]]
    along = [r["cell"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert along == sorted(along)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_hot_cells_are_split(spark, law, monkeypatch):
    monkeypatch.setattr(sharding, "IN_FINE", 50)
    df = spark.range(3000).select(F.when(F.col("id") < 1000, None).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("source"), F.lit("en").alias("lang"), F.lit("one text").alias("text"))
    got = sharding.shard(df, 7, law).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    along = [r["cell"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert along == sorted(along)


def test_common_starts_and_outliers_still_spread(spark):
    data = [(i if i else 10**15, f"https://common.example.org/{(i * 7) % 64:02d}", None if i % 64 == 0 else "en", "same") for i in range(2048)]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, text string")
    for d in ("source", "doc_id"):
        at = defaultdict(set)
        for r in sharding.shard(df, dimensions=(d,), keep=["doc_id", "source"]).collect():
            at[r["cell"]].add(r["row"][d])
        assert len(at) == 16 and sum(map(len, at.values())) == len({x for v in at.values() for x in v})
        runs = sorted(at.values(), key=min)
        assert all(max(a) < min(b) for a, b in zip(runs, runs[1:]))
        assert max(map(len, runs)) - min(map(len, runs)) <= 1
    assert len({r["cell"] for r in sharding.shard(df, dimensions=("lang",)).collect()}) == 2
    per_shard = sharding.shard(df, keep=["source"]).groupBy("shard").agg(F.countDistinct("row.source").alias("n")).collect()
    assert max(r["n"] for r in per_shard) <= 32


def test_written_shards(docs, spark, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/s", 3)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    assert back.count() == docs.count()


# Quality rules


def base_counts(text):
    w = words(text)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules(docs, rows):
    got = line_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert multiset(got) == Counter((r["doc_id"], *base_counts(r["text"])) for r in rows)


def test_frequent_lines_go_and_depleted_documents_too(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits are all one to a line's hash
    own = lambda i: " ".join(f"u{letters(i)}v{letters(k)}" for k in range(20))
    data = [(i, f"{own(i)}\nAll rights   reserved {i} forever and ever ok", "a") for i in range(40)]
    data += [(100, "ALL rights reserved 7 forever and ever ok\nmore ux vy wz q w e r t y u", "a"), (101, "\n".join(["All rights reserved 9 forever and ever ok"] * 2 + ["x y"]), "a"), (102, f"{own(2)}\nAll rights reserved 5 forever and ever ok", "b")]
    data += [(200 + i, own(777) + " copy", "a") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_rules.judge(df).collect()}
    assert got[0]["n_removed"] == 8 and got[0]["kept"]
    assert got[100]["n_removed"] == 8 and got[100]["kept"]
    assert got[101]["n_removed"] == 16 and not got[101]["kept"]
    assert got[102]["n_removed"] == 0 and got[102]["kept"]
    assert got[200]["n_removed"] == 0 and got[200]["kept"]  # copies of one document count once
    assert line_rules.judge(df.where("false")).count() == 0


def test_cleaned_texts(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    own = lambda i: " ".join(f"u{letters(i)}v{letters(k)}" for k in range(20))
    foot = "All rights   reserved 7 forever and ever ok"
    data = [(i, f"\n{foot}\n{own(i)}\n\nx{letters(i)}\n{foot.upper()}\n", "a", 5) for i in range(40)] + [(50, f"{own(50)}\n{foot}", "b", 5), (51, f"{foot}\n{foot}\nfew own words here ok", "a", 5), (52, None, "a", 5), (53, f"{own(53)} é\nend", "a", 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in line_rules.clean(df).collect()}
    kept = {r["doc_id"] for r in line_rules.judge(df).where("kept").collect()}
    assert set(got) == kept == {*range(40), 50, 53}
    for i in range(40):
        text = f"\n{own(i)}\n\nx{letters(i)}\n"
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text)
    assert got[50]["text"] == f"{own(50)}\n{foot}" and got[53]["text"] == f"{own(53)} é\nend" and got[53]["n_chars"] == 7
    assert line_rules.clean(df).columns == df.columns and line_rules.clean(df.where("false")).count() == 0


def test_limits_of_lines(spark):
    """More than min_docs, and more than max_share or max_docs: whichever of the last two a host's size reaches first."""
    data = [(i, "\n".join([f"own {chr(97 + i % 26)}{chr(97 + i // 26)} " + "v " * 3 + "end of it all", *[f"line {w} of this page here" for w, n in (("p", 60), ("q", 25), ("r", 15)) if i < n]]), "a") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    removed = lambda **o: Counter(r["n_removed"] for r in line_rules.judge(df, **o).collect())
    assert removed() == Counter({0: 240, 6: 35, 12: 25})  # a share of 15 documents is below 20
    assert removed(max_share=0.1) == Counter({0: 240, 6: 60})
    assert removed(max_share=0.5, max_docs=40) == Counter({0: 240, 6: 60})
    assert removed(max_share=0.5) == Counter({0: 300})


# Top k


def brute_top_k(data, k=5, every=50):
    """Every row but the query's own, in exact integers."""
    ints = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in data if i is not None and v and None not in v and all(map(math.isfinite, v))]
    want = Counter()
    for n, (q, a) in enumerate(ints):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for m, (c, b) in enumerate(ints) if m != n and len(a) == len(b))[:k]
            want.update((q, rank, c, -s) for rank, (s, c) in enumerate(best, 1))
    return want


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 9).round(1)]) for i in range(700)]
    data += [(1000 + i, data[3][1]) for i in range(70)] + [(50, data[50][1]), (2000, None), (2001, [None] + [0.0] * 8), (2002, [float("nan")] * 9), (2003, [float("inf")] * 9), (2050, [0.5] * 4), (2051, [0.1] * 4), (2052, []), (None, [0.1] * 9)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in data], "vec_id long, embedding array<float>, score string, rid string")
    got = topk_bitslice.top_k(df, lambda i: i % 50 == 0, rows_in_block=128, queries_in_block=8)
    singles = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    assert multiset(got.collect()) == brute_top_k(singles)
    assert topk_bitslice.top_k(df.where("false"), lambda i: i % 50 == 0).count() == 0
    assert topk_bitslice.top_k(df.where("vec_id = 50").limit(1), lambda i: i % 50 == 0).count() == 0


@pytest.mark.parametrize("in_block", [8192, 64])
def test_top_k_of_ids_with_many_vectors(spark, in_block):
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(0, 0.2, 6)) for i in range(200)]
    data += [(i, s * rng.uniform(1, 2, 6)) for i, n in ((7, 90), (9, 40), (50, 20), (61, 12)) for _ in range(n) for s in (-1, 1)]
    data += [(i, v) for i in (300, 350) for v in (np.array([0.1, 0.2]), np.array([0.2, 0.1]))] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data], "vec_id long, embedding array<double>")
    got = topk_bitslice.top_k(df, lambda i: i % 50 == 0, rows_in_block=in_block, queries_in_block=8).collect()
    assert multiset(got) == brute_top_k([(i, v.tolist()) for i, v in data])


def test_scores_of_any_size(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(rng.integers(-8, 9)) * 10.0 ** int(rng.integers(-3, 15)), 1e8 * i, -1e8 * i, 0.3]) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    wide = topk_bitslice.top_k(df, lambda i: i % 50 == 0, rows_in_block=32, score="decimal(38,0)").collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], int(r["score"])) for r in wide) == brute_top_k(data)
    assert max(r["score"] for r in wide) > 1 << 63
    huge = [(0, [1e30, -1e30, 1.0]), (1, [1e30, 1e30, 2.0]), (2, [3.0, 3.0, 3.0])]  # terms of 200 digits of two that cancel out
    got = topk_bitslice.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), lambda i: i == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 3 * 65536), (0, 2, 1, 2 * 65536)]
    with pytest.raises(Exception, match="(?i)overflow"):
        topk_bitslice.top_k(df, lambda i: i % 50 == 0).collect()


# Substrings


def brute_substrings(rows, k=13):
    first = {}
    for r in rows:
        w = words(r["text"])
        if r["doc_id"] is not None:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    out = Counter()
    for r in rows:
        w, gone = words(r["text"]), set()
        if r["doc_id"] is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < r["doc_id"]:
                    gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r["doc_id"], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("chunk", "part", "fan"), [(1_000_000, 4_000_000, 256), (3000, 5000, 256), (3000, 5000, 4), (8000, 6000, 3)])
def test_substrings(docs, rows, chunk, part, fan):
    got = substring.dedup(docs, words_in_chunk=chunk, keys_in_part=part, fan=fan).collect()
    assert multiset(got) == brute_substrings(rows)


def test_repeats_of_every_length_and_offset(spark):
    base = [f"b{i}" for i in range(60)]
    data = [(0, " ".join(base))]
    data += [(100 * n + s + 1, " ".join([f"x{n}.{s}.{j}" for j in range(s % 9)] + base[s : s + n] + [f"y{n}.{s}"])) for n in (12, 13, 14, 20) for s in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert multiset(substring.dedup(df, words_in_chunk=100).collect()) == brute_substrings([{"doc_id": i, "text": t} for i, t in data])
    assert substring.dedup(df.where("false")).count() == 0


# Quality classifier


def test_quality_on_held_out_rows(spark, docs, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = quality_qda.classify(spark.read.parquet(f"{big}/documents.parquet"), labels).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(r["quality"] == 1) == (r["predicted"] == 1) for r in held]) > 0.93


def test_quality_of_edge_rows(spark, docs, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_qda.classify(docs, labels.unionByName(spark.createDataFrame([(900001, None, 0), (None, 1, 0)], labels.schema)))
    assert got.count() == docs.count() and got.where("score is null or isnan(score)").count() == 0
    assert quality_qda.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality_qda.classify(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = labels.withColumn("quality", F.when(quality_qda.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (multiset((r["doc_id"], round(r["score"], 9)) for r in quality_qda.classify(docs, x).collect()) for x in (labels, other))
    assert a == b


# SimHash


def brute_fingerprint(text, k=4):
    w = [x.encode() for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, most=4):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def test_near_duplicates(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    ids, fps = [r["doc_id"] for r in rows], [brute_fingerprint(r["text"]) for r in rows]
    assert multiset(got) == Counter(zip(ids, [f"{f:016x}" for f in fps], brute_components(ids, fps), strict=True))
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_links_of_dense_groups_and_chains(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    dense = {centre ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(400)}
    chain, x = [], int(rng.integers(1 << 62))
    for _ in range(40):
        chain.append(x)
        x ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
    other = [int(v) for v in rng.integers(0, 1 << 63, 500)]
    fps = [*dense, *chain, *other]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").distinct()
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    want = brute_components(signed, fps)
    assert [roots.get(f, f) for f in signed] == want
    pairs = simhash.links(nodes).count()
    assert pairs < 20_000  # far from all pairs of the dense group


def test_large_groups_are_keyed_again():
    rng = np.random.default_rng(9)
    f = rng.integers(-(1 << 62), 1 << 62, 5000)
    near = f[:300] ^ np.array([sum(1 << int(b) for b in rng.choice(60, 4, replace=False)) for _ in range(300)])
    f = np.unique(np.r_[f, near])
    found = {tuple(sorted(p)) for p in simhash.group_links(np.zeros(len(f), np.int64), f, 4)}
    want = {(int(f[i]), int(f[j])) for i in range(len(f)) for j in (i + 1 + np.flatnonzero(simhash.differing(f[i + 1 :], f[i]) <= 4)).tolist()}
    assert len(want) >= 300 and found == want


def test_one_document_of_each_group_stays(docs):
    near = simhash.near_duplicates(docs)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert set(ids) >= {r["component_id"] for r in near.collect() if r["component_id"] is not None}
    assert kept.count() == simhash.near_duplicates(docs.select(F.coalesce("doc_id", -F.length(F.coalesce("text", F.lit(""))).cast("long") - 1).alias("doc_id"), "text")).select("component_id").distinct().count()
