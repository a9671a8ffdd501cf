"""The operators of the training-data pipeline against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_extract, langid, line_dedup, near_dedup, packing, pii, quality, token_counts, tokens, warc
from tessera.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, bucket string, id long, words string"


def frame(spark, *rows):
    """Documents with further columns whose names the operators use themselves."""
    rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    return spark.createDataFrame([(*r, *("en", "s", 1, 7, "b", 9, "w")) for r in rows], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}


class Union:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# Near-duplicate documents


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    union = Union(sets)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    return {i: union.find(i) for i in ids}, sets


def test_near_duplicates_equal_brute_force(small, texts):
    want, sets = brute_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(small).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_duplicates_with_outliers_and_edges(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(60):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 14)):
            words[at] = f"x{rng.integers(1_000_000)}"
        rows.append(" ".join(words))
    rows += [None, "", " \n", "one", "One", "two words", rows[0], "z " * 20000, "z " * 20000]
    want, _ = brute_components(dict(enumerate(rows)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, *rows)).collect()}
    assert got == want


def test_near_duplicates_repeated_and_null_ids(spark):
    df = frame(spark, (1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v"), (None, "a b c d e f"), (2, "a b c d e f"))
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.keep_one(df).columns == df.columns


def test_joint_estimate_is_near():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:1800], pool[300:2400]
    guess = near_dedup.similarity(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([1800.0]), np.array([2100.0]))[0]
    assert abs(guess - 1500 / 2400) < near_dedup.MARGIN
    assert (near_dedup.registers(np.union1d(a, b)) == np.maximum(near_dedup.registers(a), near_dedup.registers(b))).all()


# Decontamination


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found.update(str(x) for x in windows[key] if x is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "the cat sat on the mat and then it ran away from here"), (2, "Éa b"), (3, None), (4, ""), (5, "x"), (20, "x"), (None, "sat on"), (7, "the cat sat on the mat and then it ran far")]
TEXTS = ["THE cat, sat on the mat and then it ran away", None, "", "éa b", "Éa-b x x", "sat on " * 50, "nothing here", "THE cat, sat on the mat and then it ran away", "ran away from here the cat"]


@pytest.mark.parametrize("bound", [10_000, 0])
def test_contamination_edges(spark, bound):
    items = spark.createDataFrame([(a, b, 1) for a, b in ITEMS], "item_id long, text string, pos int")
    docs = frame(spark, *TEXTS, (None, "sat on x"), (3, "x"))
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, items, bound=bound).collect()), key=repr)
    assert got == brute_contamination([*enumerate(TEXTS), (None, "sat on x"), (3, "x")], ITEMS)
    assert decontaminate.contamination(docs.limit(0), items, bound=bound).count() == 0
    assert decontaminate.contamination(docs, items.limit(0), bound=bound).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns


# Fuzzy lines


def test_lines_near_brute_force(small, texts):
    places = defaultdict(list)
    for i, text in texts.items():
        for n, line in enumerate(text.split("\n")):
            if len(norm := line.strip(" ").lower()) >= line_dedup.LEAST_CHARS:
                places[norm].append((i, n))
    norms = sorted(places)
    sets = [{s[i : i + 5] for i in range(len(s) - 4)} for s in norms]
    union = Union(range(len(norms)))
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inverted[x])
        for j, n in common.items():
            if n >= line_dedup.THRESHOLD * (len(s) + len(sets[j]) - n):
                union.join(i, j)
        for x in s:
            inverted[x].append(i)
    groups = defaultdict(list)
    for i, norm in enumerate(norms):
        groups[union.find(i)] += places[norm]
    want = {p for g in groups.values() for p in g if p != min(g)}
    got = {(r["doc_id"], n) for r in line_dedup.dedup_lines(small).collect() for n in r["dropped"]}
    assert not got - want and len(want - got) <= 0.02 * len(want)


def test_lines_edges(spark):
    line = "The quick brown fox jumps over the lazy dog and runs away"
    near = line.replace("lazy", "lazi")
    df = frame(spark, (5, f"{line}\nshort\nshort\n{line}"), (2, f" {line.upper()}\nunique line of its own that stays here"), (9, near), (7, None), (8, ""), (None, line), (9, near), (11, "x" * 50000), (12, "x" * 50000 + "\nkept"))
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {(5, "short\nshort", 4, 2), (2, f" {line.upper()}\nunique line of its own that stays here", 2, 0), (9, "", 1, 1), (7, None, 0, 0), (8, "", 1, 0), (None, line, 1, 0), (11, "x" * 50000, 1, 0), (12, "kept", 2, 1)}
    kept = line_dedup.keep_lines(df)
    assert kept.columns == df.columns and 9 not in {r["doc_id"] for r in kept.collect()}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def jaccard(a, b):
    a, b = ({s[i : i + 5] for i in range(len(s) - 4)} for s in (a, b))
    return len(a & b) / len(a | b)


def typos(rng, line, low):
    """The line with scattered changed letters, as many as leave a similarity of ``low`` or more."""
    near = line
    while True:
        at = int(rng.integers(len(line)))
        more = near[:at] + "q" + near[at + 1 :]
        if line[at] != " " and jaccard(line, more) < low:
            return near
        near = more if line[at] != " " else near


def random_line(rng, n_words, letters):
    return " ".join("".join(rng.choice(list("abcdefghijklmnoprstuvwxyz"), letters)) for _ in range(n_words))


def test_lines_are_linked_from_three_quarters_on(spark):
    rng = np.random.default_rng(5)
    lines = [random_line(rng, 12, 8) for _ in range(150)]
    pairs = [(x, typos(rng, x, 0.75)) for x in lines]
    pairs = [(x, y) for x, y in pairs if 0.75 <= jaccard(x, y) < 0.8]
    assert len(pairs) > 30
    rows = [(10 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    dropped = {r["doc_id"] for r in line_dedup.dedup_lines(frame(spark, *rows)).where("n_dropped = 1").collect()}
    assert dropped == {10 * i + 1 for i in range(len(pairs))}


def test_long_lines_with_typos_near_the_threshold_are_linked(spark):
    rng = np.random.default_rng(6)
    lines = [random_line(rng, 20, 11) for _ in range(100)]
    pairs = [(x, typos(rng, x, 0.75)) for x in lines]
    assert all(0.75 <= jaccard(x, y) < 0.82 for x, y in pairs)
    rows = [(10 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    dropped = {r["doc_id"] for r in line_dedup.dedup_lines(frame(spark, *rows)).where("n_dropped = 1").collect()}
    assert dropped == {10 * i + 1 for i in range(len(pairs))}


def test_lines_far_below_the_threshold_are_not_verified(spark, monkeypatch):
    """1,500 lines of 20 of the same 50 words: 26,170 of their pairs share a band, none reaches a similarity of 0.5."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuvwxyz"), 8)) for _ in range(50)]
    rows = [(i, " ".join(rng.permutation(words)[:20])) for i in range(1500)]
    verified, save = [], line_dedup.Scratch.save

    def counted(self, df, name, *bounds):
        saved = save(self, df, name, *bounds)
        verified.append(saved.count() if name == "similarities" else 0)
        return saved

    monkeypatch.setattr(line_dedup.Scratch, "save", counted)
    assert line_dedup.dedup_lines(frame(spark, *rows)).where("n_dropped > 0").count() == 0
    assert sum(verified) < 1500


def test_short_lines_without_spaces_are_dropped(spark):
    line, near = "今日はとても良い天気ですね", "我们使用饼干来改善服务"
    df = frame(spark, f"{line}\n短い\n短い\n{near}", line, f"x\n{near}", "12 abc 今日")
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {0: [], 1: [0], 2: [1], 3: []}


# Packing


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(1)
    for _ in range(60):
        cap = int(rng.choice([10, 30, 2048]))
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, cap, 30), rng.integers(1, 400, 30), strict=True)}
        ranks, bins = dict.fromkeys(counts, 0), defaultdict(list)
        for n, start, end, each, base, offset in packing.plan(counts, cap).tolist():
            assert start == ranks[n] and (end - start) % each == 0
            ranks[n] = end
            bins[base].append((offset, each * n, (end - start) // each))
        assert ranks == counts
        for pieces in bins.values():
            at = 0
            for offset, size, _ in sorted(pieces):
                assert offset == at
                at += size
            assert at <= cap and len({m for _, _, m in pieces}) == 1


def test_packing_round_trip(spark, small, texts):
    rows = packing.pack(small).toPandas()
    whole = tokens.encoder(tokens.default_vocabulary()).whole
    want = sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert rows["length"].sum() == want and rows["sequence_id"].nunique() <= 1.02 * want / 2048 + 1
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert (group["offset"].to_numpy() == np.concatenate([[0], group["length"].cumsum()[:-1]])).all() and group["length"].sum() <= 2048
    for r in rows.sample(40, random_state=0).itertuples():
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert r.start == 2048 * r.piece and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    edges = packing.pack(frame(spark, None, "", (None, "a"), (4, "b"), (4, "b"), (5, "word " * 5000)))
    assert sorted(r["length"] for r in edges.collect()) == [1, 1, 2, 2, 2, 905, 2048, 2048]
    assert packing.pack(small.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Hello, WORLD's don't 12 ¿Qué? ½ªº² ÉÀß\x0b x", "a<|endoftext|>b", "ſtraße İ ́é 日本", "\x1f a\xa0b", "x" * 300, "it's.", "ΑΣ", "a.b,c"])
def test_ids_are_the_librarys(text):
    encode = tokens.encoder(tokens.default_vocabulary())
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.whole.encode(text, add_special_tokens=False).ids


# Language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97 and rows["score"].between(0, 1).all()


def test_language_edges_and_mixtures(spark, small):
    model = langid.fit(small)
    de, en = (" ".join(r["text"] for r in small.where(F.col("lang") == x).limit(8).collect()) for x in ("de", "en"))
    df = frame(spark, None, "", "123 !!", en, en + " " + de, "İİİ İ" + en, en, (None, de))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[3]["lang_pred"] == "en" and set(got[4]["languages"]) >= {"de", "en"} and got[None]["lang_pred"] == "de"
    assert sorted(r["doc_id"] for r in langid.identify(df.where("doc_id < 3"), ([], np.zeros((langid.BUCKETS, 0)))).collect()) == [0, 1, 2]
    assert langid.identify(df.limit(0)).count() == 0
    assert langid.keep_identified(small).columns == small.columns


ALPHABETS = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]


def invented(rng, alphabet, n_words=80):
    return " ".join("".join(rng.choice(list(alphabet), 6)) for _ in range(n_words))


def test_sets_of_five_languages_are_found():
    rng = np.random.default_rng(1)
    counts = np.full((langid.BUCKETS, len(ALPHABETS)), langid.PRIOR)
    for i, alphabet in enumerate(ALPHABETS):
        counts[:, i] += np.bincount(langid._grams([invented(rng, alphabet, 4000)])[0], minlength=langid.BUCKETS)
    mixed = [" ".join(invented(rng, a) for a in ALPHABETS[:k]) for k in range(1, 7)]
    _, chosen, _ = langid.infer(mixed, np.log(counts / counts.sum(0)).astype(np.float32))
    assert (chosen > 0).sum(1).tolist() == [1, 2, 3, 4, 5, 6] and np.allclose(chosen[4, :5], 0.2, atol=0.01)


def test_documents_evenly_in_three_languages_stay(spark):
    rng = np.random.default_rng(2)
    rows = [(i, invented(rng, ALPHABETS[i % 3]), "xyz"[i % 3]) for i in range(60)]
    rows += [(60, " ".join(invented(rng, a) for a in ALPHABETS[:3]), None), (61, "12 !", None)]
    kept = {r["doc_id"] for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(61))


# Quality


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_measures_equal_brute_force(texts):
    for text in [*texts.values(), None, "", " \t\n", "a\x1cb c", "x y z v w x y z v w", "a\n\na\n \n \na"]:
        assert quality.measure(text)[:5] == brute_measures(text)


def test_binomial_bounds():
    assert quality.at_most(3, 10, 0.3) == pytest.approx(0.6496107184)
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(10, 10, 0.05) == 1 and quality.at_most(5, 5, 0.5) == 1


def test_steps_stop_at_the_first_failure():
    step, bound = quality.choose_step([0, 0, 400, 0], [5, 5, 5, 500], 1000, 0.03, 0.05)
    assert step == 1 and 0 < bound <= 0.03
    assert quality.choose_step([0], [5], 10, 0.03, 0.05) == (-1, 0.0) and quality.choose_step([0], [0], 1000, 0.03, 0.05)[0] == -1


def brute_numbers(text):
    n_words, _, n_symbols, n_dup, n_repeat, n_lines, n_upper, n_bang = quality.measure(text)
    per = max(n_words, 1)
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    return failed, {"symbols": n_symbols / per, "repeated_lines": n_dup / max(n_lines, 1), "shouting": n_upper / per, "exclamation": n_bang / per, "repeated_words": n_repeat / per}


def test_verdicts_equal_brute_force(spark):
    """A text is one trial however many rows hold it; the bound is summed term by term in whole numbers."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "DELTA", "eps!", "z#", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    rows, labels = [], []
    for i in range(1600):
        good = rng.random() < 0.6
        pool = words if not good else [w for w in words if w.isalpha() and w.islower()] + ["eps!"] * (rng.random() < 0.1)
        text = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.3 else " ".join(rng.choice(pool) for _ in range(40))
        rows.append((i, text, rng.choice(("en", "de"))))
        if i % 4:
            labels += [(i, int(good))] * rng.choice((1, 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    known = dict(labels)
    trials = {}
    for i, text, lang in rows:
        if i in known and not brute_numbers(text)[0]:
            trials[lang, text] = min(trials.get((lang, text), 1), known[i])
    risk, error = Fraction(quality.RISK), Fraction(quality.ERROR) / 2
    step = {}
    for lang in ("en", "de"):
        mine = [(brute_numbers(t)[1], g) for (s, t), g in trials.items() if s == lang]
        n_good, best, worth = sum(g for _, g in mine), -1, 0
        for k in range(len(quality.PATH)):
            hit = [g for numbers, g in mine if any(numbers[rule] >= cutoff for rule, cutoff in quality.PATH[: k + 1])]
            lost, caught = sum(hit), len(hit) - sum(hit)
            tail = sum(math.comb(n_good, j) * risk**j * (1 - risk) ** (n_good - j) for j in range(lost + 1))
            if not n_good or tail > error:
                break
            if caught - quality.GOOD_IS_WORTH * lost > worth:
                worth, best = caught - quality.GOOD_IS_WORTH * lost, k
        step[lang] = best
    want = {}
    for i, text, lang in rows:
        failed, numbers = brute_numbers(text)
        want[i] = not failed and not any(numbers[rule] >= cutoff for rule, cutoff in quality.PATH[: step[lang] + 1])
    assert got == want and max(step.values()) >= 0


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 0), (2, 0)], "doc_id long, quality int")
    df = frame(spark, "good words " * 3, None, "", "a b c d e f g h i j k", (None, "x"), (3, "x"))
    got = quality.judge(df, labels).collect()
    assert len(got) == 6 and {r["doc_id"] for r in got if r["kept"]} == {3}
    assert quality.judge(df.limit(0), labels).count() == 0 and quality.judge(df, labels.limit(0)).count() == 6


# Pages


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home, all of it, and more</a></nav>
<div id="cookie-notice">We use cookies, really, many of them, and even more</div><div class=post><h2>T</h2><p>First  paragraph,
which is long enough, indeed, to be prose &amp; more.<p>Second <a href=x>link</a> one, also fine and long.<ul><li>one<li>two</ul></div>
<div class="comments"><p>Nice post, I like it, so much, really, really so much, so much</p></div><form><p>name</p></form><script>"</p>"</script><footer>&copy;</footer>"""


def test_main_text():
    assert html_extract.extract(PAGE) == "T\nFirst paragraph, which is long enough, indeed, to be prose & more.\nSecond link one, also fine and long.\none\ntwo"
    assert [html_extract.extract(x) for x in (None, "", "<p", "<", "<!-- x", "&am")] == ["", "", "", "<", "", "&am"]
    assert html_extract.extract("<article><h1>A</h1>" + "<p>" * 3000 + "deep text, here") == "A\ndeep text, here"


PROSE = ["First paragraph, which is long enough, indeed, to be prose.", "Second one, also fine, and long enough to be prose."]


@pytest.mark.parametrize("wrapper", ["<div id='content' class='has-sidebar'>", "<div class=comments-open>", "<div class='social-post'>", "<section class='with-footer'>", "<div class=widget>"])
def test_wrappers_with_listed_words_hide_nothing(wrapper):
    comments = "<div class=comments>" + "<p>Nice post, I like it, so much, really, really so much, so much</p>" * 9 + "</div>"
    page = f"<body>{wrapper}<article><p>{PROSE[0]}<p>{PROSE[1]}</article>{comments}</div><div class=ad>Buy, buy, buy this now, or never</div></body>"
    assert html_extract.extract(page) == "\n".join(PROSE)
    assert html_extract.extract(page.replace("article>", "div>")) == "\n".join(PROSE)


def test_sibling_articles_stay():
    page = f"<body><div><article>{f'<p>{PROSE[0]}' * 3}</article><article><p>{PROSE[1]}</article><article class=card><a href=/>Another text, elsewhere, to read</a></article></div>"
    assert html_extract.extract(page) == "\n".join([PROSE[0]] * 3 + PROSE[1:])


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = html_extract.main_text(df).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and all(len(r["text"]) == r["n_chars"] for r in got)
    assert html_extract.main_text(df.limit(0)).count() == 0


# Personal data


def brute_base(text):
    out = [(m.start(), m.end(), "email") for m in pii.EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in pii.CARD.finditer(text) if 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(m.start(), m.end(), "phone") for m in pii.PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_brute_force(texts):
    for text in [*texts.values(), "", "a@b@c.com x.@y.z--.a @ a@ @b.c é@b.co", "1.2.3.4.5.6.7.8 007.1.1.1 999.1.1.1", "4539 1488 0343 6467-", "+1 (482) 555-7163+4 1", "9" * 5000]:
        assert pii.base_spans(text) == brute_base(text)


def test_field_adds_and_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.fit(docs.select("text").where("text is not null"))
    df = frame(spark, "Phone: (482) 555-7163 now", None, "", "number 4283648832092188 here, version 3.", "a@b.io", (None, "tel 1"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(df, field).collect()}
    assert got[0]["spans"] == "phone:7:21" and got[0]["n_phone"] == 0
    assert got[1]["spans"] == got[2]["spans"] == got[3]["spans"] == "" and got[4]["spans"] == "email:0:6"
    assert got[4]["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()
    assert pii.find_personal_data(df.limit(0)).count() == 0


# WARC


def test_archives_round_trip(spark):
    rows = [(1, "http://a\r\nb", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (5, "u", "é\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert got[1]["refers_to"] == 2 and got[2]["record_type"] == "response" and got[2]["payload"] == "same" and got[3]["refers_to"] == 4
    assert got[5]["payload"] == "é\r\n\r\nWARC/1.1\r\n" and got[1]["url"] == "http://a%0D%0Ab" and got[3]["payload_bytes"] == 0
    assert warc.round_trip(df).count() == 7 and warc.round_trip(df.limit(0)).count() == 0


# Token counts


def test_ledger(spark):
    ledger = token_counts.TokenLedger(spark, Scratch(spark, "test").path("ledger"))
    assert ledger.totals().count() == 0
    df = frame(spark, "a b c", "d e", None, (None, "x"), (1, "d e"))
    counts = token_counts.count_tokens(df)
    assert ledger.apply(1, counts) and not ledger.apply(1, counts)
    total = lambda: {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in ledger.totals().collect()}
    assert total() == {("s", "en"): (3, 5)}
    assert ledger.apply(2, counts.where("doc_id = 0").withColumns({"lang": F.lit("de"), "n_tokens": F.lit(7)}))
    assert ledger.apply(3, counts.where("doc_id = 1 or doc_id is null"), deleted=True) and ledger.apply(4, counts.limit(0))
    assert total() == {("s", "en"): (1, 0), ("s", "de"): (1, 7)}
    assert not ledger.apply(2, counts) and ledger.apply(5, counts.where("doc_id = 1"))
    assert total()["s", "en"] == (2, 2)
    with pytest.raises(ValueError):
        token_counts.TokenLedger(spark, ledger.path).apply(0, counts)


def test_ledger_equals_recounting(spark):
    """Random batches against a dictionary of what is there; a lost writer's empty marker doesn't count."""
    rng = random.Random(1)
    ledger = token_counts.TokenLedger(spark, Scratch(spark, "test").path("ledger"))
    fs, marker = ledger._file(f"commits/{2:020d}")
    held = {}
    for batch in range(1, 6):
        if batch == 2:
            fs.create(marker, False).close()
        ids = [rng.randrange(12) for _ in range(rng.choice((1, 15)))]
        if batch % 3 == 0:
            rows = [(i, "v", None, None, 0, 0) for i in ids]
            for i in ids:
                held.pop(i, None)
        else:
            rows = [(i, "v", rng.choice("ab"), rng.choice(("en", None)), rng.randrange(100), 1) for i in ids]
            for i in set(ids):
                held[i] = max((r for r in rows if r[0] == i), key=lambda r: (r[4], r[3] or "", r[2]))
        df = spark.createDataFrame(rows, "doc_id long, tokenizer string, source string, lang string, n_tokens long, n_chars long")
        assert ledger.apply(batch, df, deleted=batch % 3 == 0) and not ledger.apply(batch, df)
        want = {}
        for r in held.values():
            documents, tokens = want.get(r[2:4], (0, 0))
            want[r[2:4]] = (documents + 1, tokens + r[4])
        got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in ledger.totals().collect() if r["documents"]}
        assert got == want


def test_a_batch_reads_only_its_parts(spark):
    ledger = token_counts.TokenLedger(spark, Scratch(spark, "test").path("ledger"))
    rows = spark.range(500).selectExpr("id as doc_id", "'v' as tokenizer", "'s' as source", "'en' as lang", "cast(1 as long) as n_tokens", "cast(1 as long) as n_chars")
    assert ledger.apply(1, rows)
    part = rows.where("doc_id = 7").select(F.pmod(F.xxhash64("doc_id"), F.lit(token_counts.PARTS)).alias("p")).first()["p"]
    files = ledger.facts([part]).inputFiles()
    assert 0 < len([f for f in files if f"part={part}/" in f]) and ledger.facts([part]).count() < 50


# Faults that were found, and the pipeline


def test_main_text_needs_no_article(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("html").where("html is not null").collect()
    for (page,) in pages:
        assert html_extract.extract(re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", page)) == html_extract.extract(page)


def test_references_are_decoded_piece_by_piece():
    assert html_extract.extract("<div><p>AT&<b>amp;</b>T is a company, with a name</div>") == "AT&amp;T is a company, with a name"


def test_links_inside_the_article_go():
    links = "<ul>" + "<li><a href=/>Another story, elsewhere, to read</a>" * 4 + "</ul>"
    page = f"<body><article>{''.join(f'<p>{x}' for x in PROSE)}{links}</article></body>"
    assert html_extract.extract(page) == "\n".join(PROSE)


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert html_extract.extract("<div>" * 100_000 + f"<p>{PROSE[0]}") == PROSE[0]
    assert time.perf_counter() - began < 10


def test_long_runs_of_digits_take_linear_time():
    began = time.perf_counter()
    assert pii.base_spans("9" * 1_000_000) == [] and pii.base_spans("1.2.3.4.5.6.7.89") == [(0, 7, "ip"), (8, 16, "ip")]
    assert time.perf_counter() - began < 5


def test_revisits_name_a_record(spark):
    scratch = Scratch(spark, "test")
    path = scratch.path("archives")
    warc.write_archives(spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "w", "other")], "page_id long, url string, html string"), path)
    heads = [head for r in spark.read.format("binaryFile").load(path).select("content").collect() for head, _ in warc._records(r["content"])]
    ids = {h["WARC-Record-ID"] for h in heads}
    assert len(ids) == 3 and {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"} < ids
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", x) for x in ids)


def test_pipeline_stages(spark, small, texts):
    import corpus_pipeline

    line = "A line that several documents share, word for word, as it is"
    rng = np.random.default_rng(8)
    own = [random_line(rng, 40, 6) for _ in range(4)]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("size(split(text, ' ')) > 12").first()["text"]
    more = [(900_001, f"{own[0]}\n{line}"), (900_002, f"{own[1]}\n{line}"), (900_003, own[2]), (900_004, own[2] + " more"), (900_005, f"{own[3]} {item}"), (900_006, "12 !"), (900_007, None)]
    extra = frame(spark, *more).select(*small.columns).withColumn("lang", F.lit("en"))
    docs = small.unionByName(extra).withColumns({"_gone": F.lit(1), "row": F.lit(2), "gone": F.lit(3)})
    clean = [i for i, _ in more[:2]]

    found = corpus_pipeline.lines(spark, docs, SMALL)
    rows = {r["doc_id"]: r["text"] for r in found.collect()}
    assert found.columns == docs.columns and rows[900_001].endswith(line) and rows[900_002] == own[1]
    found = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    ids = {r["doc_id"] for r in found.collect()}
    assert found.columns == docs.columns and 900_003 in ids and 900_004 not in ids and ids.issuperset(clean)
    found = corpus_pipeline.decontamination(spark, docs, SMALL)
    ids = {r["doc_id"] for r in found.collect()}
    assert found.columns == docs.columns and 900_005 not in ids and ids.issuperset([*clean, 900_003])
    found = corpus_pipeline.language(spark, docs, SMALL)
    ids = {r["doc_id"] for r in found.collect()}
    assert found.columns == docs.columns and not ids & {900_006, 900_007}
    pieces = corpus_pipeline.packing(spark, docs.where("doc_id > 900000"), SMALL).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in more}
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
