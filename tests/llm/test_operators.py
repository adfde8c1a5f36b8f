"""Every operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import decontam, html_extract, lm_mixing, minhash, mixing, quality_knn, quality_rules, secrets, sharding, textlib, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(7)
VOCAB = ["the", "of", "and", "to", "is"] * 12 + ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


ODD = [(None, "null id here", "a"), (1, None, None), (2, "", "b"), (3, " \t\n ", "b"), (4, "word", "b"), (4, "word", "b"), (5, "é ü ñ " * 3, "a"), (6, "x " * 30_000, "c"), (7, "a" * 100_000, "c")]
AWKWARD = ["_words", "size", "cls", "source_size", "part", "shard", "position", "take", "own", "run"]


def awkward(df):
    for c in AWKWARD:
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_words_follow_the_contract():
    texts = ["The CAT\tsat\x0bé\x0c\x1ctab", "", None, "  a  ", "x" * 3_000_000 + " y"]
    for w in textlib.sub_batches(pa.array(texts)):
        for r in range(w.lo, w.hi):
            a, b = w.first[r - w.lo], w.first[r - w.lo + 1]
            got = [bytes(w.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b])]
            assert got == (texts[r] or "").encode().lower().split() and len(set(w.hashes[a:b].tolist())) == len(set(got))


# --- op1 -----------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted((str(d), len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    rows = [(i, t) for i, t, _ in ODD]
    base = prose(60, 1).split()
    for i in range(120):  # copies with more and more substitutions: links, near misses and chains
        w = list(base)
        for j in np.random.default_rng(i).choice(60, i % 9, replace=False):
            w[j] = f"new{i}x{j}"
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, prose(25, 50 + i)) for i in range(40)] + [(400, base_text := " ".join(base)), (401, base_text), (401, base_text)]
    df = awkward(docs(spark, [(i, t, "s") for i, t in rows]))
    got = minhash.near_duplicates(df, k=2, percent=80)
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 2, 80)


def test_dropping_near_duplicates_goes_by_rows_not_ids(spark):
    one, two, three = prose(50, 1), prose(50, 2), prose(50, 3)
    rows = [(1, one, "a"), (1, two, "b"), (None, one, "c"), (None, three, "d"), (None, three, "d"), (2, two + " tail", "e"), (None, None, "f"), (None, None, "f"), (3, "", "g")]
    df = awkward(docs(spark, rows)).withColumn("row", F.lit("clash"))
    got = minhash.drop_near_duplicates(df, k=5, percent=80)
    assert got.columns == df.columns
    kept = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    assert kept == Counter([(1, one, "a"), (1, two, "b"), (None, three, "d"), (None, None, "f"), (None, None, "f"), (3, "", "g")])


def test_near_duplicates_of_a_third_of_all_rows(spark):
    rows = [(i, prose(40, 999 if i % 3 == 0 else i), "s") for i in range(90)] + [(200 + i, prose(40, 999) + f" end{i}", "s") for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), k=2).collect()}
    assert all(got[i] == (0 if i % 3 == 0 or i >= 200 else i) for i in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, []), k=2).count() == 0
    assert minhash.near_duplicates(docs(spark, [(1, None, "a"), (2, "", "a")])).filter("component_id = doc_id and kept").count() == 2


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(rnd.randrange(2000, 4000), rnd.randrange(2000, 4000)) for _ in range(900)] + [(7, 7)]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    root = {x: x for e in edges for x in e}
    while True:
        new = dict(root)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    want = sorted((x, r) for x, r in root.items() if x != r)
    spark.sparkContext.setJobGroup("components", "")
    got = minhash.components(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setJobGroup("other", "")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert jobs <= 12, jobs
    # forests of a few nodes in partitions of a few edges leave work to the stars
    monkeypatch.setattr(minhash, "_forest", lambda frames: (f for f in frames))
    rounds = minhash.components(df.repartition(6))
    assert sorted(tuple(r) for r in rounds.collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(minhash, "FOREST", 3)
    forests = pd.concat(minhash._forest(iter([pd.DataFrame(edges[i : i + 5], columns=["a", "b"]) for i in range(0, len(edges), 5)])))
    assert sorted(tuple(r) for r in minhash.components(spark.createDataFrame(forests)).collect()) == want and forests["a"].isin(forests["b"]).any()



def test_block_links_lose_no_pair():
    sets = [list(range(i, i + 40)) for i in range(0, 60, 3)]
    t = pa.table({"cls": pa.array(range(20), pa.int64()), "root": pa.array(range(20), pa.int64()), "elements": pa.array(sets, pa.list_(pa.int64())), "asks": pa.array([False] * 20)})
    both = pa.concat_tables([t, t.set_column(3, "asks", pa.array([True] * 20))])
    got = {tuple(sorted(x)) for x in zip(*(c.to_pylist() for c in minhash._block_links(80)(both).columns))}
    want = {(i, j) for j in range(20) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert got == want and want


def test_superminhash_estimates_similarity():
    a, b = np.arange(1, 201, dtype=np.uint64), np.arange(51, 251, dtype=np.uint64)
    rows = np.repeat([0, 1], 200)
    sig = minhash.superminhash(rows, textlib.mix(np.concatenate([a, b])), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.13
    one = minhash.superminhash(np.array([0]), np.array([5], np.uint64), 1)
    assert len(np.unique(one >> np.uint64(56))) == minhash.SLOTS  # one element reaches every slot, each at its own step


# --- op2 -----------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rows = [(i, prose(5 + i % 40, i), f"s{i % 7}" if i % 3 else "hot") for i in range(400)] + ODD
    placed = mixing.place(awkward(docs(spark, rows)))
    got = mixing.digest(placed).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    total, names = 1.5 * sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        level = (total - sum(2 * size[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        free -= over
    target = {s: level * weight[s] if s in free else 2.0 * size[s] for s in names}
    by = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert by == {(size[s], round(target[s], 6)) for s in names}
    assert sum(r["taken"] for r in got) == sum(int(t) for t in target.values())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1 and all((r["position"] is None) == (r["taken"] == 0) for r in got)
    again = mixing.digest(mixing.place(docs(spark, rows[::-1]))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_rows_repeat_documents(spark):
    df = docs(spark, [(i, prose(20, i), f"s{i % 3}") for i in range(60)])
    takes = {r["doc_id"]: len(r["takes"]) for r in mixing.place(df).collect()}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in takes.items() if n})
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.digest(mixing.place(docs(spark, [(1, None, None)]))).first()["taken"] == 0


def test_equal_rows_are_dealt_to_runs(spark, monkeypatch):
    rows = [(i, prose(8, i), "hot") for i in range(40)] + [(7, prose(8, 7), "hot")] * 60 + [(None, None, None)] * 30
    want = Counter((r["doc_id"], r["taken"]) for r in mixing.place(docs(spark, rows)).collect())
    monkeypatch.setattr(mixing, "HEAVY", 10)
    got = mixing.place(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["taken"] for r in got) == sum(t * n for (_, t), n in want.items())
    starts = sorted(t["position"] for r in got for t in r["takes"])
    assert len(set(starts)) == len(starts)  # no two of the equal rows stand at one place


def test_demand_curve_inverts():
    for knots in mixing.SCHEDULES:
        parts = mixing.Curve(knots).segments()
        assert parts[0][0] == 0 and parts[-1][1] == 1
        assert sum((a + b) / 2 / len(parts) for *_, a, b in parts) == pytest.approx(1)


# --- op3 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark, 3000))


def test_secrets_found_and_others_left(spark, forest):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    yes = [f"the password={h('a')[:18]} here", f'a token = "{h("b")[:40]}" end', "on AKIA" + "Q7M2ZK4P9XW3B6TL" + " and", f"api_key: {h('c')[:32]}"]
    no = [f"see commit {h('d')[:40]} for", "id 123e4567-e89b-12d3-a456-426614174000 seen", "call +1 (499) 555-6503 or 4041894974608795", "open release-notes-version-2024 now", "key your_api_key_here_1234 x"]
    rows = [(i, t, "s") for i, t in enumerate(yes + no)] + [(100 + i, t, s) for i, (_, t, s) in enumerate(ODD)] + [(0, yes[0], None)]
    got = secrets.scan(awkward(docs(spark, rows)), model=forest).filter("is_secret").collect()
    assert {r["doc_id"] for r in got} == set(range(len(yes)))
    assert sum(r["doc_id"] == 0 for r in got) == 2
    assert secrets.scan(docs(spark, []), model=forest).count() == 0


def test_secrets_are_found_anywhere_in_a_word(spark, forest):
    h = lambda x, n=32: hashlib.sha256(x.encode()).hexdigest()[:n]
    wrapped = [f'token = "{h("a")}"!! so', f'a token = "{h("b")}"### b', f'{{"key":"{h("c")}"}}', f'[password:"{h("d")}"], x', f"postgres://admin:{h('e')}@db.example.com/x", "the password: Xy7kP2mQ9 here", f"(secret={h('f')}]"]
    two = f"password={h('g')};token={h('i')};api_key={h('j')}"
    plain = ["call 555-6503-1234 on 2024-11-12 from 10.20.30.44", "password: required", "version: release-notes2", "a" * 100_000 + "=" + "b" * 100_000, "=" * 50_000 + " " + "x1" * 50_000 + ":" * 50_000]
    rows = [(i, t, "s") for i, t in enumerate([*wrapped, two, *plain])]
    got = defaultdict(set)
    for r in secrets.scan(docs(spark, rows), model=forest).filter("is_secret").collect():
        got[r["doc_id"]].add(r["candidate"])
    want = [{h(c)} for c in "abcde"] + [{"Xy7kP2mQ9"}, {h("f")}, {h(c) for c in "gij"}]
    assert [got[i] for i in range(len(want))] == want
    assert not any(got[len(want) + i] for i in range(3))


def test_forest_separates_held_out_findings(spark, forest):
    held = secrets.labelled_findings(spark, 4500).filter("hash(word) % 3 = 0")
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.with_features(held))
    r = forest.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("ok")).first()
    assert r["ok"] > 0.97


# --- op4 -----------------------------------------------------------------------------------------


def test_crf_on_held_out_pages():
    chain = html_extract.trained_chain()
    wrong = total = 0
    for page in html_extract.labelled_pages(120, seed=77):
        found = [b for b in html_extract.blocks(page) if b.label is not None]
        wrong += sum(x != bool(b.label) for x, b in zip(chain.main(found), found))
        total += len(found)
    assert wrong / total < 0.01


def test_extract_reads_odd_pages(spark):
    body = "<article><h1>T&amp;T</h1><p>One&nbsp;two\n three <b>bo</b>ld.</p><script>if (a < b) '</p>'</script><p>Caf&eacute; &#8364;5</p></article>"
    page = f"<html><head><title>no</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now.</div>{body}<div class='comments'><p>Nice one!</p></div><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<article><p>open <!-- never closed"), (5, "u", "<<>>"), (None, "u", page), (1, "u", page), (6, "u", "<article>" + "<p>word here now.</p>" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = html_extract.extract(df).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[None] == "T&T One two three bold. Café €5" and texts[2] == texts[3] == ""
    assert texts[4] == "open" and len(texts[6].split()) == 15000 and len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_scripts_and_open_heads_hide_no_text():
    text = lambda page: " ".join(b.text for b in html_extract.blocks(page))
    assert text("<p>one</p><script>for(i=0;i<n;i++){f(i)}</script><p>two</p>") == "one two"
    assert text("<p>one</p><script>s = '<!--' + \"<p>\"</SCRIPT ><p>two</p><script>x</script>") == "one two"
    assert text("<style>a<b{}</styles></style><p>two</p><textarea><!--</textarea>three<script>'</p>") == "two three"
    for body in ("<body><p>two</p>", "<p>two</p>", "<div>two</div></body>", "two"):
        assert text(f"<html><head><meta charset=x><title>no</title><noscript><img src=x>no</noscript><script>if(a<b)c</script>\n{body}") == "two"
    assert text("<head><noscript>no<body><p>two") == "two" and text("<head><title>no</title></head><p>two") == "two"


# --- op5 -----------------------------------------------------------------------------------------


def brute_rules(t):
    t = t or ""
    words = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_equal_brute_force(spark):
    rep = prose(10, 3)
    texts = [t for _, t, _ in ODD] + [prose(100, 1), " ".join([rep] * 4), f"{rep}\n{rep}\n \n{rep}", "# $ % " * 30, f"{prose(30, 4)} {rep} {prose(9, 5)} {rep}", "A!! B!! " * 20]
    df = awkward(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["kept"] and r["base_failed"])
    assert got[len(ODD)]["kept"] and quality_rules.keep(docs(spark, [])).count() == 0
    assert {r["doc_id"] for r in quality_rules.keep(df).collect()} == {i for i, r in got.items() if r["kept"]}


def test_rules_leave_extra_columns_alone(spark):
    df = awkward(docs(spark, [(1, prose(40, 1), "s")])).withColumns({c: F.lit("clash") for c in ("_words", "_words_", "_lines", "_row")})
    judged = quality_rules.apply_rules(df)
    assert set(df.columns) <= set(judged.columns) and judged.first()["_words"] == judged.first()["_lines"] == "clash"
    assert quality_rules.keep(df).columns == df.columns and quality_rules.keep(docs(spark, [(1, prose(120_000, 2), "s")])).count() == 1


# --- op6 -----------------------------------------------------------------------------------------


def test_neighbours_vote_on_held_out_documents(spark):
    good = [(i, prose(60, i).capitalize() + ".", 1) for i in range(200)]
    bad = [(200 + i, " ".join(w + "###" for w in prose(60, i).split()), 0) for i in range(60)]
    rows = good + bad
    df = awkward(docs(spark, [(i, t, "s") for i, t, _ in rows] + [(1000 + i, t, s) for i, (_, t, s) in enumerate(ODD)]))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(1, None, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_knn.score(df, labels).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and all(got[i]["predicted"] == q for i, q in held)
    none = quality_knn.score(df, labels.limit(0)).first()
    assert none["score"] == 0.5 and quality_knn.score(docs(spark, []), labels).count() == 0


def test_vote_equals_a_full_sort_of_cosines():
    texts = [prose(30 + i, i).replace("a", "ä" if i % 2 else "a") + "!?#|"[i % 4] * (i % 7) for i in range(120)] + ["", "one"]
    x = np.concatenate([f for _, _, f in quality_knn.features(pa.array(texts))])
    model = quality_knn.fit(x[:80], [i % 3 == 0 for i in range(80)], dimensions=12)
    got = quality_knn.vote(model, x)
    for i, row in enumerate(x):
        if not row.any():
            assert got[i] == pytest.approx(float(model["labels"].mean()))
            continue
        v = (row - model["centre"]) @ model["directions"]
        cosine = model["vectors"] @ (v / np.linalg.norm(v))
        near = np.argsort(-cosine, kind="stable")[: quality_knn.NEIGHBOURS]
        weight = np.maximum(0, cosine[near]).astype(float) ** quality_knn.SHARPNESS + 1e-6
        assert got[i] == pytest.approx(float((weight * model["labels"][near]).sum() / weight.sum()), abs=1e-4)


# --- op7 -----------------------------------------------------------------------------------------


def brute_url(u):
    host, path = "", ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best
    return host, path, None, "block" if re.search(r"(?:^|[.-])(?:casino|bets|adult|spam|pills|ads)(?:[.-]|$)", host) else "allow"


def test_url_filters_equal_brute_force(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://Example.ORG/en/12?x=1", "https://a.b.example.org/es/#f", "http://myexample.org/es/1", "http://x.com/fr/", "http://x.com/de/casino", "ftp://casino-win.net/a", "http://x.net/casino", "http://spam-farm.example.org/en/2", "http://org", "http://u@h:80/de/://org/", "http://É.com/fr/É", "http://free-bets.com/en/" + "a" * 50_000]
    df = awkward(spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[5]), (5, urls[5])], "page_id long, url string"))
    got = url_filter.digest(url_filter.judge(df)).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = urls[5 if r["page_id"] is None else r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(u)
    assert url_filter.judge(df, rules=()).filter("verdict = 'allow'").count() == len(got) and url_filter.judge(df.limit(0)).count() == 0


def test_url_filters_with_many_blank_and_equal_urls(spark):
    rows = [(i, None if i % 3 == 0 else "no scheme" if i % 3 == 1 else "http://a.example.org/en/1/" + "x" * (20_000 if i < 9 else 3)) for i in range(300)]
    got = url_filter.digest(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))).collect()
    assert Counter((r["rule"], r["verdict"]) for r in got) == Counter({(None, "allow"): 200, ("example.org/en/1", "block"): 100})


# --- op8 -----------------------------------------------------------------------------------------


def test_leaks_found_with_substitutions_and_fragments_left(spark):
    items = [(i, prose(12 + 3 * i, 900 + i)) for i in range(12)] + [(50, prose(9, 960)), (51, "too short item"), (52, None), (None, ""), (60, prose(21, 903))]
    rows, want = [], set()
    for i, t in items:
        w = (t or "").split()
        if len(w) < decontam.LEAST_WORDS:
            continue
        rows.append((1000 + i, f"{prose(40, i)} {t} {prose(30, i + 1)}", "s"))
        want.add((1000 + i, 3 if i == 60 else i))
        if len(w) >= 20:
            v = [x if j % 8 != 3 else "other" for j, x in enumerate(w)]
            rows.append((2000 + i, f"{prose(20, i)}\n{' '.join(v).upper()},", "s"))
            want.add((2000 + i, 3 if i == 60 else i))
        rows.append((3000 + i, f"{prose(40, i)} {' '.join(w[:6])} {prose(30, i)}", "s"))
    rows += [(i, t, s) for i, t, s in ODD if i is not None] + [(1000, rows[0][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit("clash"))
    got = decontam.leaks(awkward(docs(spark, rows)), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    kept = decontam.drop_leaks(docs(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontam.leaks(docs(spark, []), bench).count() == 0 and decontam.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_short_items_leak_under_every_allowed_substitution(spark):
    items = [(n, " ".join(f"q{n}w{j}" for j in range(n))) for n in range(1, 13)]
    rows, want = [], set()
    for n, t in items:
        w, free = t.split(), n // 5 if n >= decontam.LEAST_WORDS else 0
        outs = [*itertools.combinations(range(n), free), *itertools.combinations(range(n), free + 1)]
        for out in outs:
            i = len(rows)
            v = ["other" if j in out else x for j, x in enumerate(w)]
            rows.append((i, " ".join([*["before"] * (i % 3), *v, *["after"] * (i % 2)]), "s"))
            if len(out) <= free:
                want.add((i, n))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs(spark, rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


# --- op9 -----------------------------------------------------------------------------------------


def held(i, fold=2, folds=7):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def corpus(n=150):
    words = lambda i: " ".join(np.random.default_rng(i).choice(VOCAB[60 + i % 2 :: 2], 80)) + (" fresh%d" % i if i % 5 == 0 else "")
    return [*ODD, *((10 + i, words(i), "s") for i in range(n)), *((900 + i, words(3) + f" tail{i % 2}", "s") for i in range(12))]


def test_beginnings_that_tokens_share_are_laid_once():
    words = ["running", "runner", "run", "runs", "rung", "ünder", "under", "x"] * 2
    data, lens = np.frombuffer(("".join(words) + "\n").encode(), np.uint8), np.array([len(w.encode()) for w in words] + [1])
    ends = np.cumsum(lens)
    starts, kind = ends - lens, np.arange(len(lens)) // 8
    levels = [np.random.default_rng(k).integers(0, 1 << 12, 1 << bits).astype(np.uint16) for k, (*_, bits) in enumerate(lm_mixing.PREDICTORS)]
    code, speller = lm_mixing.Code(np.bincount(data, minlength=256) + 1), lm_mixing.Speller(lm_mixing.Mixer(levels))
    whole, once = (lm_mixing.Steps(code, data, starts, ends, kind, once=x) for x in (False, True))
    assert len(once.at) < len(whole.at)
    got = speller.logs(once)
    assert np.allclose(got, speller.logs(whole), atol=1e-9) and not np.allclose(got[:8], got[8:16])
    alone = [speller.logs(lm_mixing.Steps(code, data, starts[i : i + 1], ends[i : i + 1], kind[i : i + 1]))[0] for i in range(len(lens))]
    assert np.allclose(got, alone, atol=1e-9)
    # tokens that their match bits guess are not spelled, others as before
    t = {"token": np.array([hash(w) & (1 << 62) - 1 for w in [*words, "\n"]], np.uint64), "kind": kind, "start": starts, "end": ends, "data": data}
    some = lm_mixing.spell(speller, code, t, np.array([0, 3]))
    assert np.allclose(lm_mixing.spell(speller, code, t), got, atol=1e-9) and some[0] == some[3] == 0 and np.allclose(np.delete(some, [0, 3]), np.delete(got, [0, 3]), atol=1e-9)



def test_lm_base_equals_brute_force_and_model_learns(spark):
    rows = corpus()
    got = lm_mixing.digest(lm_mixing.score(awkward(docs(spark, rows)))).collect()
    assert len(got) == len(rows)
    c = Counter()
    for i, t, _ in rows:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        w = [*(t or "").encode().lower().split(), None]
        want[(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    tests = [r for r in got if r["held_out"] and r["n_tokens"] > 50 and r["n_known"] == r["n_tokens"]]
    assert tests and sum(r["score"] for r in tests) > sum(r["base_score"] for r in tests)
    assert lm_mixing.score(docs(spark, [])).count() == 0
    alone = lm_mixing.score(docs(spark, [(next(i for i in range(99) if held(i)), "never trained", "s")])).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0 and math.isfinite(alone["score"])


def coded(rows, model):
    """Scores of all rows of one region, coded one text, word and bit at a time."""
    texts = [[*(t or "").encode().lower().split(), None] for _, t, _ in rows]
    train = [not held(i) for i, _, _ in rows]
    hash_of, short = {None: int(lm_mixing.END[0])}, {}
    for w in textlib.sub_batches(pa.array(sorted({x.decode() for t in texts for x in t if x}), pa.string())):
        for h, a, b in zip(w.hashes.tolist(), w.starts, w.ends):
            hash_of[bytes(w.data[a:b])] = h
    short = {x: (h >> 40) % lm_mixing.BUCKETS for x, h in hash_of.items() if x is not None and len(x) <= lm_mixing.SHORT}
    mixer, code = model.mixer, model.code
    odds = np.log(mixer.seen[:, :, 1] / mixer.seen[:, :, 0])

    def spelled(word, kind):
        data = np.frombuffer(word if word is not None else b"\n", np.uint8)
        s = lm_mixing.Steps(code, data, np.array([0]), np.array([len(data)]), np.array([kind]))
        total = 0.0
        for i in range(len(s.at)):
            state = [int(lm_mixing._state[t[x[i]]]) for t, x in zip(mixer.levels, s.slots)]
            gate = min(int(s.place[s.at[i]]), 7) * 2 + int(s.depth[i]) + 16 * (state[5] > 0) + 32 * (state[4] > 0) + 64 * (state[3] > 0)
            y = max(-16, min(16, sum(mixer.weights[gate, k] * odds[k][x] for k, x in enumerate(state))))
            zero, one = mixer.refined[gate, round(max(-8, min(8, y)) * 2) + 16]
            p = min(1 - 1e-6, max(1e-6, (1 / (1 + math.exp(-y)) + one / (zero + one)) / 2))
            total += math.log10(p if s.bit[i] else 1 - p)
        return total

    def kind_of(words):
        found = [short[w] for w in words if w in short]
        return int(np.argmax(model.weights[found].sum(axis=0))) + 1 if found else 0

    bucket = lambda x: max(i for i, c in enumerate(lm_mixing.COUNTS) if c <= x)
    before = lambda t, j, order: tuple(t[j - k] if j >= k else "start" for k in range(1, order + 1))
    after = {order: defaultdict(lambda: defaultdict(set)) for order in (2, 3)}
    for d, t in enumerate(texts):
        for j, w in enumerate(t):
            for order in (2, 3):
                after[order][before(t, j, order)][w] |= {d} if train[d] else set()
    steps = []
    token = np.array([hash_of[w] for t in texts for w in t], np.uint64)
    place = np.array([j for t in texts for j in range(len(t))])
    order = iter(textlib.mix(lm_mixing.contexts(token, place, 3) + token).tolist())
    for d, t in enumerate(texts):
        own, past = defaultdict(list), []
        for j, w in enumerate(t):
            follow = []
            last = own[before(t, j, 3)]
            follow.append((last[-1], bucket(len(last)), len(last) > 1 and last[-1] == last[-2]) if last else None)
            for n_words in (3, 2):
                of_all = after[n_words][before(t, j, n_words)]
                best = sorted(of_all.items(), key=lambda x: (-len(x[1]), hash_of[x[0]]))[:2]
                left = [(len(of - {d}), x) for x, of in best] + [(0, None)] * (2 - len(best))
                n, x = left[0] if left[0][0] >= left[1][0] else left[1]
                follow.append((x, bucket(n), bucket(max(1, sum(map(len, of_all.values())) // n))) if n > 0 else None)
            own[before(t, j, 3)].append(w)
            lead = next((i for i, f in enumerate(follow) if f), None)
            step = {"d": d, "w": w, "kind": kind_of(t[:j]), "hit": None, "order": next(order)}
            if lead is not None:
                guess = follow[lead][0]
                gate = tuple(0 if f is None else 1 + (f[0] != guess) for f in follow)
                five = tuple(past[j - k] if j >= k else 0 for k in range(1, 6))
                streak = next((i for i, x in enumerate(reversed(past)) if x != 2), len(past))
                step |= {"hit": guess == w, "gate": gate, "states": [f and (*f[1:], f[0] != guess) for f in follow]}
                step["contexts"] = [(lead, *follow[lead][1:], bucket(streak), five[0]), (gate, *five[:3]), five]
            past.append(0 if lead is None else 1 + step["hit"])
            steps.append(step)
    p_of = bit_probabilities([x for x in steps if x["hit"] is not None], train)
    out, memo = [0.0] * len(texts), {}
    for x in steps:
        d, p = x["d"], p_of.get(id(x))
        if x["hit"]:
            out[d] += math.log10(p)
            continue
        if (x["w"], x["kind"]) not in memo:
            memo[x["w"], x["kind"]] = spelled(x["w"], x["kind"])
        out[d] += memo[x["w"], x["kind"]] + (math.log10(1 - p) if p is not None else 0)
    return out


def bit_probabilities(steps, train):
    """What the mixed match predictors say of each bit, one bit at a time; weights move after each mini-batch."""
    counts, seen = Counter(), Counter()
    for x in steps:
        if train[x["d"]]:
            counts.update((k, c, x["hit"]) for k, c in enumerate(x["contexts"]))
    level = lambda n: max(i for i, g in enumerate(lm_mixing.GRID) if g <= n)
    for x in steps:
        states = list(x["states"])
        for k, c in enumerate(x["contexts"]):
            zero, one = (counts[k, c, bit] - (train[x["d"]] and x["hit"] == bit) for bit in (False, True))
            states.append(int(lm_mixing._state[level(zero) * 256 + level(one)]))
        x["states"] = states
        if train[x["d"]]:
            seen.update((k, s, x["hit"]) for k, s in enumerate(states))
    for x in steps:
        x["odds"] = [0.0 if s is None else math.log((seen[k, s, True] + 0.05) / (seen[k, s, False] + 0.95)) for k, s in enumerate(x["states"])]
    weights = defaultdict(lambda: [lm_mixing.MATCH_START] * 6)
    squares = defaultdict(lambda: [1e-6] * 6)
    squash = lambda y: 1 / (1 + math.exp(-y))
    mixed = lambda x: max(-16.0, min(16.0, sum(w * o for w, o in zip(weights[x["gate"]], x["odds"]))))
    trained = [x for x in steps if train[x["d"]]]
    batches = max(1, -(-len(trained) // lm_mixing.MATCH_MINI))
    for b in range(batches):
        by = defaultdict(list)
        for x in trained:
            if (x["order"] >> 32) * batches >> 32 == b:
                by[x["gate"]].append((x, x["hit"] - squash(mixed(x))))
        for gate, rows in by.items():
            for k in range(6):
                slope = sum(e * x["odds"][k] for x, e in rows) / len(rows)
                squares[gate][k] += slope * slope
                weights[gate][k] += lm_mixing.MATCH_RATE * slope / math.sqrt(squares[gate][k])
    y = {id(x): mixed(x) for x in steps}
    place = lambda x: round(max(-8, min(8, y[id(x)])) * 2)
    after = Counter((x["gate"], place(x), x["hit"]) for x in trained)
    out = {}
    for x in steps:
        start, cell = squash(place(x) / 2), (x["gate"], place(x))
        ones = after[(*cell, True)] + 20 * start
        refined = ones / (20 + after[(*cell, True)] + after[(*cell, False)])
        out[id(x)] = max(1e-6, min(1 - 1e-6, (squash(y[id(x)]) + refined) / 2))
    return out


def test_lm_scores_equal_a_sequential_coder(spark, monkeypatch):
    rows = [(i, (t or "")[:400] if i in (6, 7) else t, s) for i, t, s in corpus(30)]
    df = docs(spark, rows)
    model = lm_mixing.fit(df)
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm_mixing.score(df, model=model).collect())
    want = sorted((str(i), x) for (i, _, _), x in zip(rows, coded(rows, model)))
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-5)
    # the same with several mini-batches, as one region in this process
    monkeypatch.setattr(lm_mixing, "MATCH_MINI", 300)
    t = lm_mixing._region(pa.array([t or "" for _, t, _ in rows]), model.weights)
    train = np.array([not held(i) for i, _, _ in rows])
    bits = lm_mixing.match_bits(t["token"], t["doc"], t["place"], train[t["doc"]], lm_mixing.spell(lm_mixing.Speller(model.mixer), model.code, t))
    assert np.bincount(t["doc"], weights=bits) == pytest.approx(np.array(coded(rows, model)), rel=1e-5)
    # copies are told apart: others' words predict them, their own do not
    by = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_mixing.score(df, model=model).collect()}
    assert min(by[900 + i] for i in range(12)) > max(by[10 + i] for i in range(30) if i != 3)


def test_lm_scores_do_not_depend_on_order_or_files(spark):
    rows = corpus(60)
    one = {(r["doc_id"], r["n_bytes"]): r["score"] for r in lm_mixing.score(docs(spark, rows).coalesce(1)).collect()}
    two = {(r["doc_id"], r["n_bytes"]): r["score"] for r in lm_mixing.score(docs(spark, rows[::-1]).repartition(5)).collect()}
    assert one == pytest.approx(two, rel=1e-7)


def test_lm_regions_bound_copies_and_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(lm_mixing, "CHUNK", 20_000)
    rows = [(i, prose(40, i), "s") for i in range(100)] + [(500 + i, prose(60, 777), "s") for i in range(150)] + [(None, None, "s")] * 50
    df = docs(spark, rows)
    model = lm_mixing.fit(df)
    dealt = lm_mixing.regions(lm_mixing._documents(df, "doc_id", "text", 7, 2).withColumn("row", F.monotonically_increasing_id()), model.sizes, 5)
    assert dealt.count() == len(rows) and dealt.filter("doc_id >= 500").select("chunk").distinct().count() > 1
    got = lm_mixing.score(df, model=model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)


def test_match_bits_adapt_along_a_copy():
    """Copies in the training texts teach that hits follow hits: a held-out copy costs less a word in its later part; row order does not matter."""
    rng = np.random.default_rng(3)
    body = [rng.integers(1, 400, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(40)]
    texts = [*body, *[b.copy() for b in body[:16]]]
    token, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), 300)
    place, train = np.tile(np.arange(300), len(texts)), doc < 48
    spelled = np.full(len(token), -3.0)
    s = lm_mixing.match_bits(token, doc, place, train, spelled)
    copy, alone = doc >= 48, (doc >= 16) & (doc < 40)
    assert s[copy & (place > 150)].mean() > s[copy & (place < 20)].mean()
    assert s[copy & (place > 150)].mean() > -0.1 and s[alone].mean() > -3.2
    again = np.concatenate([np.flatnonzero(doc == d) for d in rng.permutation(len(texts))])
    t = lm_mixing.match_bits(token[again], np.repeat(np.arange(len(texts)), 300), place[again], train[again], spelled)
    assert t == pytest.approx(s[again], rel=1e-9)


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(5)
    m = lm_mixing.Mixer([rng.integers(0, 1 << 16, 1 << bits).astype(np.uint16) for *_, bits in lm_mixing.PREDICTORS])
    code = lm_mixing.Code(rng.integers(1, 1000, 256))
    total = 0.0
    for byte in range(256):
        s = lm_mixing.Steps(code, np.array([byte, 0], np.uint8), np.array([0]), np.array([2]), np.array([1]))
        first = s.at == 0
        found, gate = m.read(s, False)
        y = m.mixed(found, gate)[0]
        p = np.clip((lm_mixing._squash(y) + (m.refined[:, :, 1] / m.refined.sum(axis=2))[gate, m.step(y)]) / 2, 1e-6, 1 - 1e-6)
        total += np.prod(np.where(s.bit == 1, p, 1 - p)[first])
    assert total == pytest.approx(1)


def test_kinds_follow_words_that_occur_together():
    both = np.zeros((lm_mixing.BUCKETS, lm_mixing.BUCKETS), np.int64)
    for k in range(4):
        both[k * 10 : k * 10 + 10, k * 10 : k * 10 + 10] = 100 - k
    weights = lm_mixing.fit_kinds(both + (both.sum(axis=1, keepdims=True) > 0) * (both.sum(axis=0) > 0))
    assert len({tuple(np.argmax(weights[k * 10 : k * 10 + 10], axis=1)) for k in range(4)}) == 4
    assert all(len(set(np.argmax(weights[k * 10 : k * 10 + 10], axis=1))) == 1 for k in range(4))
    assert not lm_mixing.fit_kinds(both * 0).any()


# --- op10 ----------------------------------------------------------------------------------------


def test_shards_are_exact_and_gapless(spark):
    rows = [(i, prose(3, i), "s") for i in range(500)] + ODD + [(9, "same", "s")] * 300
    got = sharding.digest(sharding.shard(awkward(docs(spark, rows)))).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.digest(sharding.shard(docs(spark, rows[::-1]).repartition(5))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.shard(docs(spark, [])).count() == 0


def test_matrix_has_exact_margins_and_hypergeometric_means():
    counts = [5, 0, 1000, 17, 300]
    sums = np.zeros((5, 4))
    for seed in range(200):
        m = np.array(sharding.communication_matrix(counts, 4, seed))
        assert m.sum(axis=1).tolist() == counts and set(m.sum(axis=0)) <= {330, 331}
        sums += m
    assert np.allclose(sums / 200, np.outer(counts, [331, 331, 330, 330]) / 1322, rtol=0.08, atol=0.2)
    r = np.random.Generator(np.random.PCG64(1))
    big = [sharding.hypergeometric(r, 2_000_000_000, 2_000_000_000, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 500) < 4 and 12 < np.std(big) < 20


# --- column names, whatever their case ------------------------------------------------------------


def test_columns_that_differ_in_case_come_back(spark):
    names = ["Row", "ROW_", "row__", "Again", "_Words", "_LINES", "Own", "once"]
    df = docs(spark, [(1, prose(60, 1), "a"), (2, prose(60, 1), "a"), (3, prose(60, 2), "b"), (None, None, "b")]).withColumns({c: F.lit(f"keep {c}") for c in names})
    bench = spark.createDataFrame([(1, prose(60, 2))], "item_id long, text string")
    kept = minhash.drop_near_duplicates(df)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3] and kept.columns == df.columns
    clean = decontam.drop_leaks(df, bench)
    assert sorted((r["doc_id"] or 0) for r in clean.collect()) == [0, 1, 2]
    measured = quality_rules.measure(df)
    for out in (kept, clean, measured):
        assert all(r[c] == f"keep {c}" for r in out.collect() for c in names)


def test_rules_without_ascii_tokens(spark):
    rules = (url_filter.site_rule("block", "例え/"), url_filter.site_rule("block", "com/"))
    df = spark.createDataFrame([(1, "http://例え/a"), (2, "http://x.例え/"), (3, "http://a.com/"), (4, "http://a.org/"), (5, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules=rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules=url_filter.rules_table(spark, rules)).collect()} == got
