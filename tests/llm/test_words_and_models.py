"""Word arrays, the two classifiers, token counts and fingerprints."""

import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasestream.llm import fingerprints, quality, token_counts, toxicity
from phrasestream.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \t\n", "é", " a b ", "x" * 40_000, "ab cd ef g", "no\x00w z😀z", "w " * 9_000, "same text here", "same text here"]


def test_words_are_runs_without_ascii_space():
    data, offsets = W.flat(pa.array(ODD))
    starts, lengths, first = W.words(data, offsets)
    got = [[data[s : s + n].tobytes().decode() for s, n in zip(starts[a:b], lengths[a:b])] for a, b in zip(first, first[1:])]
    assert got == [WORD.findall(t or "") for t in ODD]


def test_hashes_depend_on_the_bytes_alone():
    a, b = W.flat(pa.array(["alpha beta", "gamma alphabeta alpha"])), W.flat(pa.array(["x alpha"]))
    ha = W.hash_spans(a[0], *W.words(*a)[:2])
    hb = W.hash_spans(b[0], *W.words(*b)[:2])
    assert ha[0] == ha[4] == hb[1] and len(set(ha.tolist())) == 4
    assert W.windows(ha, 2)[0] != W.windows(ha, 2)[1] and len(W.windows(ha, 9)) == 0


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ODD, "n": list(range(len(ODD)))})
    parts = list(W.slices(iter([batch, batch.slice(0, 0)]), most=1000))
    assert len(parts) > 2 and [n for p in parts for n in p.column("n").to_pylist()] == list(range(len(ODD)))


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 AS size", "'x' AS hash", "2 AS _score", "3 AS tid", "4 AS _words", "'s' AS source", "'y' AS lang") if extra else df


def labelled(seed=1, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("red blue green stone river cloud hill".split()) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Grobbo", "grobbolings", "fnarl"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_learns_terms_and_takes_odd_rows(spark):
    docs, labels = labelled()
    docs = docs + [(None, "fnarl stone"), (1000, None), (1001, ""), (1001, "")]
    df, marks = table(spark, docs), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks, W.fold_of(F.col("_id")) != 0, sample=300)
    got = toxicity.score(df, model).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs) and "size" in got[0]
    assert sum(by_id[i]["_predicted"] == y for i, y in labels) >= 0.98 * len(labels)
    assert by_id[None]["_predicted"] == 1 and by_id[1000]["_score"] == by_id[1001]["_score"] < 0.5


def test_pairs_of_terms_are_learned_beyond_their_single_weights(spark):
    """Either term alone is harmless, both together are not."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(800):
        a, b = i % 2, (i // 2) % 2
        words = ["filler", *(["zulip"] if a else []), *(["marvo"] if b else []), rng.choice(["one", "two"])]
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    got = {r["doc_id"]: r["_predicted"] for r in toxicity.score(df, model).collect()}
    assert all(got[i] == y for i, y in labels)


@pytest.mark.parametrize("rule", ["either both or none", "insult beside a group"])
def test_pairs_of_neutral_terms_are_found(rule):
    """Among forty other terms; neither term of the pair is a feature by itself."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        others = rng.sample(range(100, 220), 40)
        rows.append(np.unique([5, *([10] if a else []), *([11] if b else []), *others]))
        labels.append(int(a == b) if rule.startswith("either") else int(a and b))
    model = toxicity._fit(np.array(labels[:1200]), rows[:1200])
    assert {10, 11} <= set(model.buckets.tolist())
    for row, y in zip(rows[1200:], labels[1200:]):
        at = [model.buckets.tolist().index(t) for t in row if t in model.buckets]
        pairs = sum(model.factors[i] @ model.factors[j] for k, i in enumerate(at) for j in at[:k])
        assert (model.bias + model.weights[at].sum() + pairs > 0) == bool(y)


def test_scores_equal_the_plain_sum_over_terms_and_pairs():
    rng = np.random.default_rng(3)
    texts = [None, "", "alpha", "alpha beta alpha", "Beta, gamma-DELTA alphabet " * 3, "x" * 30_000 + " beta", "é beta"]
    terms = sorted({b for t in texts for b in toxicity.hashed_terms(pa.array([t or ""]))[1].tolist()})[::2]
    model = toxicity.Model(-0.3, np.array(terms), rng.normal(0, 1, len(terms)), rng.normal(0, 0.4, (len(terms), toxicity.FACTORS)))
    place = np.full(toxicity.BUCKETS, -1)
    place[model.buckets] = np.arange(len(terms))
    got = toxicity.score_texts(pa.array(texts), model, place)
    for text, score in zip(texts, got):
        have = [terms.index(b) for b in set(toxicity.hashed_terms(pa.array([text or ""]))[1].tolist()) if b in terms]
        z = model.bias + sum(model.weights[i] for i in have) + sum(
            model.factors[i] @ model.factors[j] for k, i in enumerate(have) for j in have[:k])
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_models_without_labels_or_rows(spark):
    df = table(spark, [(1, "a b")])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(df, toxicity.fit(df, none, F.lit(True))).first()["_predicted"] == 0
    assert quality.score(df, quality.fit(df, none, F.lit(True))).first()["_score"] == 0.5
    assert toxicity.score(df.limit(0), toxicity.fit(df, none, F.lit(True))).count() == 0
    assert quality.score(df.limit(0), np.zeros(quality.BUCKETS + 1)).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
        if i % 3 == 0:
            words = [w + "!!" for w in words] if i % 2 else [w for w in words[:5] for _ in range(8)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 != 0)))
    df = table(spark, rows + [(900, None), (None, "a")])
    weights = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"), W.fold_of(F.col("_id")) != 0)
    got = quality.score(df, weights).select("doc_id", "_predicted", (W.fold_of(F.col("doc_id")) == 0).alias("held")).collect()
    held = [(r["doc_id"], r["_predicted"]) for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 500]
    assert len(got) == 502 and len(held) > 50 and sum(p == labels[i][1] for i, p in held) >= 0.97 * len(held)


PIECES = {"▁": -3.0, "a": -4.0, "b": -4.0, "ab": -5.0, "▁a": -5.5, "ba": -5.0, "abab": -8.0, "bb": -9.0, "▁ba": -6.0}


def plain_tokens(word: str, pieces: dict, byte_score: float) -> int:
    """Best segmentation by trying each way for each prefix."""
    text = "▁" + word
    best = {0: (0.0, 0)}
    for j in range(1, len(text) + 1):
        ways = [(best[i][0] + pieces[text[i:j]], -(best[i][1] + 1)) for i in range(j) if text[i:j] in pieces]
        n = len(text[j - 1].encode())
        ways.append((best[j - 1][0] + byte_score * n, -(best[j - 1][1] + n)))
        score, few = max(ways)
        best[j] = score, -few
    return best[len(text)][1]


def test_trie_counts_equal_plain_segmentation():
    found = {"".join(w).encode() for n in range(1, 7) for w in product("abé", repeat=n)}
    got = token_counts.trie_counts(found, PIECES, 4, -19.0)
    assert got == {w: plain_tokens(w.decode(), PIECES, -19.0) for w in found}


def test_token_counts_of_odd_rows(spark):
    df = table(spark, list(enumerate(ODD)) + [(None, "ab")])
    got = token_counts.token_counts(df, PIECES).collect()
    want = {i: sum(plain_tokens(w, PIECES, -19.0) for w in WORD.findall(t or "")) for i, t in enumerate(ODD) if i != 5}
    assert {r["doc_id"]: r["_tokens"] for r in got if r["doc_id"] in want} == want
    assert {r["doc_id"]: r["_words"] for r in got} == {i: len(WORD.findall(t or "")) for i, t in enumerate(ODD)} | {None: 1}
    assert token_counts.token_counts(df.limit(0), PIECES).count() == 0


def test_vocabulary_file_is_read():
    pieces = token_counts.load_pieces()
    assert len(pieces) > 20_000 and "<s>" not in pieces and "▁the" in pieces


def test_fingerprints_of_near_texts_are_alike():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(4000))
    near = text[:1500] + "inserted" + text[1500:3000] + text[3010:]
    other = "".join(rng.choice("abcdefghij klmno") for _ in range(4000))
    a, b, c = map(fingerprints.fingerprint, (text, near, other))
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.6 > 0.3 > fingerprints.likeness(a, c)
    assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a)
    assert set(fingerprints.bands(a)) & set(fingerprints.bands(near and a))


def test_walks_side_by_side_equal_walks_alone():
    rng = random.Random(4)
    texts = ["", "a", *("".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(1, 900))) for _ in range(40))]
    chars = [fingerprints.codes(t) for t in texts]
    times, ends = fingerprints.walks(chars, np.arange(len(texts)))
    for i, c in enumerate(chars):
        t = i
        for k, x in enumerate(c.tolist()):
            assert times[i][k] == t
            t += fingerprints.STAY[x][t % fingerprints.PERIOD]
        assert ends[i] == t


def test_texts_that_differ_in_one_place_have_different_fingerprints():
    """Wherever the place is: at the head of a long text, too."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    whole, tail = text(4000), text(4000)
    heads = {fingerprints.fingerprint(text(12) + tail) for _ in range(100)}
    assert len(heads) >= 99
    for at in (0, 40, 100, 200):
        assert fingerprints.fingerprint(whole) != fingerprints.fingerprint(whole[:at] + "#############" + whole[at + 13:])


def test_likeness_follows_edit_distance():
    """The share of characters that are replaced, in one stretch, against the likeness."""
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    near = []
    for share in (0, 5, 20, 50, 80, 100):
        found = []
        for _ in range(12):
            a = text(1500)
            n = 15 * share
            at = rng.randrange(1500 - n + 1)
            found.append(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a[:at] + text(n) + a[at + n:])))
        near.append(sum(found) / len(found))
    assert near[0] == 1 and near[-1] < 0.15 and all(a > b for a, b in zip(near, near[1:])), near


def test_an_edited_text_has_the_fingerprint_of_its_own():
    text, following = "some words é😀 " * 50, "other words"
    row = fingerprints._rows([1], [text], [following], chained=False)[0]
    made = text[: len(text) - len(text) // 3] + following
    assert fingerprints.edited(text, following) == made
    assert f"{row['edited_t']:x}:{row['edited_bits'].hex()}" == fingerprints.fingerprint(made)


@pytest.mark.parametrize("parts", [1, 3])
def test_fingerprints_pair_each_text_with_the_next_smaller_id(spark, parts):
    rows = [(i * 7, t) for i, t in enumerate(ODD)] + [(None, "null id text"), (14, "second of this id")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = fingerprints.fingerprints(table(spark, rows).repartition(3)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    import hashlib
    want = set()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        made = fingerprints.edited(t, nxt)
        a, b, c = (fingerprints.fingerprint(x) for x in (t, made, nxt))
        want.add((i, len(t), hashlib.sha256(made.encode()).hexdigest(), a, b, round(fingerprints.likeness(a, b), 9), round(fingerprints.likeness(a, c), 9)))
    assert {(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in got} == want and len(got) == len(rows)
    assert fingerprints.fingerprints(table(spark, rows).limit(0)).count() == 0


def test_near_pairs_finds_copies_with_small_edits(spark):
    rng = random.Random(2)
    rows = []
    for i in range(20):
        text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
        rows += [(2 * i, fingerprints.fingerprint(text)), (2 * i + 1, fingerprints.fingerprint(text[:900] + "zz" + text[902:]))]
    got = {(r["doc_id"], r["other_id"]) for r in fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    # A walk falls back into step after an edit with constant probability, not surely.
    assert got <= {(2 * i, 2 * i + 1) for i in range(20)} and len(got) >= 10
