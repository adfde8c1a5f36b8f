"""Chat formatting, whitening and spelling variants against plain versions of their rules, with odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import chat_format, decontam, html_extract, spelling, whitening

# --- op11 ----------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"
CHATS = [
    (1, 0, "user", "a[INST]b"), (1, 1, "user", r"[\INST] [\\/INST][INST"), (1, 2, "assistant", None), (1, 3, "assistant", "x[AND]y"), (1, 4, None, "[ROLE]"), (1, 5, "tool[/ROLE]", "</s>"),
    (None, None, "user", "é\U0001d4b3"), (None, 3, "assistant", "[["), (None, 3, "assistant", "["), (None, 3, "assistant", "["), (2, 0, "assistant", ""), (3, 1, "", ""), (3, 2, "", "q"), (4, 0, "system", "<s>"), (4, 1, "user", "\\"), (4, 2, "system", "x" * 200_000 + "[SYS]"),
] + [(5, i, ["user", "assistant"][i % 2] if i % 7 else "user", f"turn {i} [INST] " * 3) for i in range(1200)]


def test_chats_equal_sql(spark):
    got = chat_format.digest(chat_format.format_chats(spark.createDataFrame(CHATS + chat_format.PLANTED, CHAT).repartition(3)))
    con = duckdb.connect()
    con.register("conversations", pa.table({k: pa.array([r[i] for r in CHATS]) for i, k in enumerate(("conv_id", "turn", "role", "text"))}))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(chat_format.oracle_sql()).fetchall()))


def test_formatted_text_by_hand(spark):
    rows = [(1, 2, "assistant", "fine"), (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 3, "assistant", "</s> and [INST]"), (1, 4, "tool", "t")]
    out = chat_format.format_chats(spark.createDataFrame(rows, CHAT)).first()
    assert out["formatted"] == r"<s>[SYS]be kind[/SYS][INST]hi[/INST]fine[AND]<\/s> and [\INST]</s>[ROLE]tool[/ROLE]t"
    assert [out["formatted"][s["start"] : s["start"] + s["length"]] for s in out["loss_spans"]] == ["fine", r"<\/s> and [\INST]"]


@pytest.mark.parametrize("template", [chat_format.Template(), chat_format.Template("<bos>", (("user", "<|user|>", ""), ("assistant", "<|assistant|>", "<|end|>")), ("<|role|>", "<|/role|>"), "<|and|>")])
def test_any_text_comes_back(spark, template):
    rng, signs = np.random.default_rng(3), [*template.controls(), "[", "<", "\\", "x", "INST]", "s>", "|", "\n", "é"]
    rows = [(c, t, str(rng.choice(["user", "assistant", "system", "odd[ROLE]"])), "".join(rng.choice(signs, rng.integers(0, 9)))) for c in range(60) for t in range(int(rng.integers(1, 9)))]
    out = chat_format.format_chats(spark.createDataFrame(rows, CHAT), template).select("conv_id", chat_format.read_turns(F.col("formatted"), template).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans"), template).alias("loss"))
    for r in out.collect():
        mine = [x[2:] for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["t"]] == mine and r["loss"] == "".join(t for role, t in mine if role == "assistant")


def test_chats_without_rows_and_with_other_columns(spark):
    empty = spark.createDataFrame([], CHAT)
    assert chat_format.digest(chat_format.format_chats(empty)).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "a")], CHAT).withColumns({c: F.lit(1) for c in ("turns", "runs", "parts", "Formatted", "row")})
    assert chat_format.digest(chat_format.format_chats(more)).first()["n_turns"] == 1


def test_control_strings_must_be_distinct():
    with pytest.raises(ValueError):
        chat_format.Template(joint="[INST]")
    with pytest.raises(ValueError):
        chat_format.Template(joint="AND")


# --- op12 ----------------------------------------------------------------------------------------


def plain_whitening(rows, k):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in good])
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(0)
    c = once - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    trace = (c * c).sum() / n
    return {i: (n, int(((n * v - s) ** 2).sum()), (v - s / n) @ u / np.sqrt(e)) for (i, _), v in zip(good, x)}, e / trace


def test_whitening_equals_an_eigensolver(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=7) * [1, 2, 3, 4, 5, 0, 1e-9] + 1000]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(100)]  # a third of the rows is one vector
    odd = [(500, None), (501, [1.0, None] + [1.0] * 5), (502, [float("nan")] * 7), (503, [float("inf")] * 7), (505, [1.0, 2.0]), (506, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5).withColumns({c: F.lit("clash") for c in ("x", "N", "component", "place")})
    want, explained = plain_whitening(rows, 4)
    got = defaultdict(dict)
    for r in whitening.whiten(df).collect():
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == set(want)
    signs = np.sign([[got[i][c]["whitened"] * want[i][2][c - 1] for c in range(1, 5)] for i in want]).sum(0)
    for i, (n, deviation, w) in want.items():
        assert sorted(got[i]) == [1, 2, 3, 4]
        for c, r in got[i].items():
            assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["whitened"] * np.sign(signs[c - 1]) - w[c - 1]) < 1e-9
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_whitening_of_few_and_large_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, None)])).count() == 0
    two = whitening.whiten(frame([(1, [0.0, 0.0]), (None, [1.0, 1.0])])).collect()
    assert [(r["component"], r["n"], r["explained"], abs(r["whitened"])) for r in two] == [(1, 2, pytest.approx(1), pytest.approx(1))] * 2
    large = whitening.whiten(frame([(i, [4e14 * i, 4e14 * (i * i % 7)]) for i in range(40)])).collect()
    assert len(large) == 80 and all(r["deviation"] is None and r["identity_error"] < 1e-9 for r in large)


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_jacobi_on_the_factor(d):
    g = np.random.default_rng(d).normal(size=(d + 3, d)) * np.logspace(0, -6, d)
    v = g.T @ g
    lower, order = whitening.pivoted_cholesky(v)
    assert np.allclose(lower @ lower.T, v[order][:, order], rtol=1e-12, atol=1e-18)
    turned = whitening.orthogonal_columns(lower)
    assert np.allclose(np.sort((turned * turned).sum(0))[-d:], np.linalg.svd(g, compute_uv=False)[::-1] ** 2, rtol=1e-8)


# --- op13 ----------------------------------------------------------------------------------------


def plain_variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = 1 if d is None else zlib.crc32(f"{d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
            holes[i, rest].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return out


def variant_docs():
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abcé×"), rng.integers(7, 13))) for _ in range(12)] + ["station", "stations", "Ärgerlich", "c" * 9, "c" * 10]
    words = []
    for s in stems:
        for _ in range(40):
            t, at = list(s), int(rng.integers(0, len(s)))
            t[at : at + int(rng.integers(0, 2))] = rng.choice(list("abcé×"), int(rng.integers(0, 3)))
            words.append("".join(t))
    share = rng.dirichlet(np.full(len(words), 0.03))
    texts = [(i, " ".join(rng.choice(words, 80, p=share))) for i in range(60)]
    chain = [(100, "abcdefg " * 3 + "abcdefgh " * 40 + "abcdefghi " * 500), (101, "abcdefghij " * 6000)]
    long = ["x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "x" * 2999]
    return [*texts, *chain, (102, " ".join(long * 2)), (103, None), (104, ""), (105, "STATION STATION, short ÀÀÀÀÀÀÀ-ÀÀÀÀÀÀÀ"), (None, "stationx stationx"), (105, "STATION STATION"), (105, "STATION STATION")]


@pytest.mark.parametrize("most", [4096, 5])
def test_variants_equal_brute_force(spark, most):
    rows = variant_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("Word", "n", "key", "part", "size")})
    got = spelling.group_variants(df, most=most).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["root"] != (r["form"] or r["word"]) for r in got)


def test_no_variants_without_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_open_group_is_answered_in_batches(monkeypatch):
    """Guests that come in many batches meet the index that stays, and nobody asks twice."""
    monkeypatch.setattr(spelling, "CHUNK_ROWS", 4)
    words = sorted(f"aaaaaa{a}{b}" for a in "bcdef" for b in "bcdef")
    rows = [(16, 1, 0, False, w, 2) for w in words[:6]] + [(16, 1, 0, True, w, 2) for w in words[6:]] + [(16, 2, 0, False, w, 2) for w in words[:2]]
    batch = pa.RecordBatch.from_pylist([dict(zip(("kind", "key", "part", "guest", "word", "n"), r)) for r in rows])
    got = Counter()
    for out in spelling._search(iter([batch])):
        for r in out.to_pylist():
            got[r["word"]] += r["n_near"]
    one = lambda x, y: sum(a != b for a, b in zip(x, y)) == 1
    want = Counter({w: sum(one(w, v) for v in words[:6]) + (w in words[:2]) for w in words})
    assert got == +want


# --- op4 and op8, what earlier tests left out -----------------------------------------------------


def test_breaks_inside_a_word_join_it():
    assert [b.text for b in html_extract.blocks("<p>super<wbr>cali <b>x</b>y</p><p>z")] == ["supercali xy", "z"]


def test_pages_of_many_open_elements_take_linear_time():
    import time

    times = []
    for n in (8_000, 32_000):
        start = time.process_time()
        html_extract.blocks("<div>" * n + "</span>" * n + "text")
        times.append(time.process_time() - start)
    assert times[1] < 12 * max(times[0], 0.02)


def plain_leaks(docs, items):
    """Every window of an item against every place of every document."""
    out = set()
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            v = item.lower().split()
            n = min(decontam.WINDOW, len(v))
            spare = n // 5 if n >= decontam.LEAST_WORDS else 0
            for k in range(len(v) - n + 1):
                if any(sum(a != b for a, b in zip(v[k : k + n], w[j : j + n])) <= spare for j in range(len(w) - n + 1)):
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_a_plain_scan_of_all_windows(spark):
    """On texts over few words, so that windows agree by chance in all degrees about four fifths."""
    rng = np.random.default_rng(11)
    words = list("abcdefghijkl")
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 40))))) for i in range(25)]
    docs = []
    for d in range(120):
        w = list(rng.choice(words, int(rng.integers(0, 60))))
        if d % 2:
            v = items[int(rng.integers(0, 25))][1].split()
            v = [x if rng.random() > 0.18 else str(rng.choice(words)) for x in v]
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = v
        docs.append((d, " ".join(w)))
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    firsts = {}
    for i, t in items:
        firsts.setdefault(t, i)
    want = {(d, firsts[dict(items)[i]]) for d, i in plain_leaks(docs, items)}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 60
