"""Joins, windows, spans, language model, mixing and the pipeline against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasestream.llm import decontaminate, jaccard_join, language_model, mixing, pii, substring_dedup
from phrasestream.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ("1 AS size", "'x' AS hash", "3 AS tid", "4 AS at", "5 AS n", "6 AS unit", "7 AS spans", "8 AS target")


def words_of(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, ties and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "kstnhm" for b in ("a", "e", "ri", "un", "ol")] + ["The", "é😀", "."]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "x", "yz"]) for _ in range(k))
    passage = text(30)
    rows = []
    for i in range(n):
        body = text(rng.choice([0, 1, 3, 7, 20, 80, 150]))
        if i % 5 == 0:
            body += " \n" + passage + "\t" + text(5)
        rows.append((i, body))
    for i in range(0, n, 6):
        w = rows[i][1].split(" ")
        rows.append((n + i, rows[i][1]))
        if len(w) > 60:
            rows.append((2 * n + i, " ".join(w[:30] + ["changed"] + w[31:])))
    return rows + [(None, passage), (None, None), (500, None), (501, ""), (502, " \n"), (503, "x" * 30_000), (504, passage), (504, passage)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return df.selectExpr("*", *EXTRA) if extra else df


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus()
    lowest = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                lowest[key] = min(lowest.get(key, i), i)
    want = collections.Counter()
    for i, t in rows:
        w = words_of(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and lowest[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_repeated_runs_double_until_none_is_left(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[40:150])), (3, " ".join(words[200:216]))]
    got = collections.Counter((r["doc_id"], r["words"]) for r in substring_dedup.repeated_runs(frame(spark, rows)).collect())
    assert got == {(2, 13): 98, (2, 26): 85, (2, 52): 59, (2, 104): 7, (3, 13): 4}


def brute_links(rows, least=0.8):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words_of(t)) else set()) for i, t in rows]
    links, parent = collections.Counter(), {i: i for i, _ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and b and len(a & b) >= least * len(a | b) - 1e-9:
                links[x] += 1
                links[y] += 1
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return collections.Counter((i, find(i) if i is not None else None, links[x]) for x, (i, _) in enumerate(sets))


@pytest.mark.parametrize("small", [128, 2])
def test_jaccard_join_equals_brute_force(spark, small, monkeypatch):
    """With small = 2 groups are split to the greatest depth and worked on as pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = corpus(seed=3)
    got = jaccard_join.similar_documents(frame(spark, rows)).select("doc_id", "class_id", "n_links").collect()
    assert collections.Counter(tuple(r) for r in got) == brute_links(rows)
    if small == 128:
        assert jaccard_join.similar_documents(frame(spark, rows).limit(0)).count() == 0


def test_recall_of_the_runs():
    assert jaccard_join.recall(1) > 0.999999 and jaccard_join.recall(3) > 0.999


@pytest.mark.parametrize("aim", [0.9, 0.9995, 0.99999])
def test_paths_end_before_recall_falls_below_the_aim(spark, aim, monkeypatch):
    """Sets that no split tells apart go as deep as the aim lets them, and no deeper."""
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    depth = jaccard_join.depth_for(aim)
    assert jaccard_join.recall(depth) >= aim > jaccard_join.recall(depth + 1)
    assert jaccard_join.recall(jaccard_join.depth_for(jaccard_join.RECALL)) >= 0.999 > jaccard_join.recall(6)
    sets = spark.createDataFrame([(i, b"\1" * 256) for i in range(5)], "set_id long, sig binary")
    asked = []
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name: asked.append(name) or df)
    jaccard_join.leaves(sets, depth)
    assert asked == [f"jaccard-level{k}" for k in range(1, depth + 1)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard_join.components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5}


def weighted_similarity(a, b, weight):
    a, b = (collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)]) for w in (a, b))
    both = sum(weight(x) * min(a[x], b[x]) for x in a)
    return both / (sum(weight(x) * n for x, n in a.items()) + sum(weight(x) * n for x, n in b.items()) - both)


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 40)))) for k in range(12)] + [(50, None), (51, ""), (None, "a b c d e f"), (52, "two words")]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(40)]
    for i in range(0, 40, 4):
        w = items[i % 12][1].split()
        if i % 8 == 0 and len(w) > 20:
            w[len(w) // 2] = "edited"
        rows[i] = (i, rows[i][1] + "\n" + " ".join(w) + " " + rows[i][1])
    rows += [(None, items[3][1]), (None, "clean text of a null id"), (90, None), (91, ""), (92, items[5][1]), (92, items[5][1])]
    df = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS size", "2 AS h")
    used = collections.Counter(x for k, t in items if k is not None and words_of(t)
                               for x in {tuple(words_of(t)[j : j + 5]) for j in range(max(1, len(words_of(t)) - 4))})
    total = sum(k is not None and bool(words_of(t)) for k, t in items)
    weight = lambda x: math.log1p(total / used[x]) if x in used else math.log1p(total)
    want = set()
    for i, t in rows:
        w = words_of(t)
        for k, item in items:
            b = words_of(item)
            if k is None or not b or not w:
                continue
            spans = [w[a : a + len(b)] for a in range(max(1, len(w) - len(b) + 1))]
            if max(weighted_similarity(s, b, weight) for s in spans) >= 0.8:
                want.add((i, k))
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and len(want) >= 8
    dirty = {i for i, _ in want if i is not None}
    kept = [r for r in decontaminate.clean(df, bench).collect()]
    assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter(i for i, t in rows if i not in dirty and not (i is None and t == items[3][1]))
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


RULES = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), no, m.end(), kind) for no, (kind, rule) in enumerate(RULES.items()) for m in rule.finditer(text or "") if accepted(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    bits = ["a", "b", ".", "@", "1", "2", "9", "-", " ", "+", "(", ")", "é", "_", "4111111111111111", "1.2.3.4", "a@b.co", "+1 (555) 123-4567", "\n", "😀", "255", "x.y@z.w"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, None), (5001, "1" * 50_000), (5002, "1." * 20_000), (5003, "a." * 20_000 + "@"), (5004, "a@b.c " * 2_000), (5005, "+1" + " " * 20_000), (None, "a@b.c"), (None, "a@b.c")]
    got = pii.personal_data(frame(spark, rows)).collect()
    base = lambda r: [x for x in r["spans"].split(",") if x and not x.startswith("term")]
    want = collections.Counter((i, hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest(), ",".join(plain_spans(t))) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["base_sha256"], ",".join(base(r))) for r in got) == want
    assert all([r[f"n_{k}"] for k in RULES] == [sum(x.startswith(k) for x in base(r)) for k in RULES] for r in got)
    assert pii.personal_data(frame(spark, rows).limit(0)).count() == 0


def brute_disclosing(rows, disclosed, support):
    """Terms at or above the threshold, by plain counting over all texts."""
    address = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    letters = re.compile(r"[^\W\d_]+")
    uses, places, n_t = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for _, text in rows:
        text = text or ""
        words = [(m.start(), m.end(), m.group().lower()) for m in letters.finditer(text)]
        n_t.update(w for _, _, w in words)
        spans = [(m.start(), m.end(), m.group()) for m in address.finditer(text)]
        met = set()
        for a, b, value in spans:
            for x, y, w in words:
                # A word that touches the end of the reach may go on there, and is left out.
                left = y <= a and (x > a - pii.REACH or a <= pii.REACH)
                if (left or (x >= b and y < b + pii.REACH)) and not any(x < d and c < y for c, d, _ in spans):
                    met |= {(value, w, x), ("", w, x)}
        for value, w, x in met:
            uses[value, w] += 1
            places[value, w].add((text, x))
    total, n_e = sum(n_t.values()), collections.Counter()
    for (value, _), n in uses.items():
        n_e[value] += n
    entities = collections.Counter(w for value, w in uses if value)
    out = {}
    for (value, w), n in uses.items():
        gain = math.log2(n * total / (n_t[w] * n_e[value])) / max(math.log2(total / n_e[value]), 1e-9)
        if len(places[value, w]) >= support and (value or entities[w] >= support) and gain >= disclosed:
            out[w, value] = gain
    return out


def disclosing_rows():
    rng = random.Random(4)
    common = [f"{a}{b}" for a in "kstnhm" for b in ("a", "e", "ri", "un", "ol")]
    text = lambda k: " ".join(rng.choice(common) for _ in range(k))
    rows = [(i, text(rng.randrange(5, 60))) for i in range(80)]
    for i in range(12):  # always beside one address; twice elsewhere, once in a row of its own
        rows.append((100 + i, f"{text(9)} Marlowe writes from m.low@there.org {text(9)}"))
    rows += [(150, text(30) + " Marlowe " + text(30)), (151, "marlowe")]
    for i in range(9):  # a cue that stands near ever other addresses
        rows.append((200 + i, f"{text(20)} mailto u{i}@x{i}.net {text(20)}"))
    rows += [(300 + i, "rarepair a@b.co") for i in range(10)]  # copies are no support
    return rows + [(400, None), (None, "Marlowe"), (401, ""), (402, "Marlowe m.low@there.org"), (402, "Marlowe m.low@there.org"), (403, text(20_000) + " MARLOWE")]


def test_disclosing_terms_equal_brute_force(spark):
    rows = disclosing_rows()
    df = frame(spark, rows)
    got = {(r["term"], r["value"]): r["disclosure"] for r in pii.disclosing_terms(df, pii.with_base(df), disclosed=0.3, support=3).collect()}
    want = brute_disclosing(rows, 0.3, 3)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {("marlowe", "m.low@there.org"), ("mailto", "")} <= set(want) and not any("rarepair" in k for k in want)


def test_disclosing_terms_go_wherever_they_stand(spark):
    rows = disclosing_rows()
    df = frame(spark, rows)
    terms = {w for w, _ in brute_disclosing(rows, 0.9, pii.SUPPORT)}
    assert {"marlowe", "writes", "from", "mailto"} == terms
    names = re.compile(r"[^\W\d_]+")
    address = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    want = collections.Counter()
    for i, t in rows:
        base = [(m.start(), 0, m.end(), "email") for m in address.finditer(t or "")]
        more = [(m.start(), 4, m.end(), "term") for m in names.finditer(t or "") if m.group().lower() in terms and not any(m.start() < b and a < m.end() for a, _, b, _ in base)]
        want[i, len(base), len(more), ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + more))] += 1
    got = collections.Counter((r["doc_id"], r["n_email"], r["n_term"], r["spans"]) for r in pii.personal_data(df, disclosed=0.9).collect())
    assert got == want
    clean = collections.defaultdict(list)
    for r in pii.sanitised(df, disclosed=0.9).collect():
        clean[r["doc_id"]].append(r["text"])
    assert clean[151] == ["[TERM]"] and clean[None] == ["[TERM]"] and clean[402] == ["[TERM] [EMAIL]"] * 2 and clean[400] == [None]
    assert clean[403][0].endswith(" [TERM]") and clean[0] == [rows[0][1]]


def test_terms_that_disclose_are_found_and_generalised(spark):
    rows = [(i, f"noise words here {i} and call Contactperson +1 (555) 100-{1000 + i} okay noise") for i in range(30)]
    rows += [(100 + i, "noise words and okay here call it") for i in range(100)]
    rows += [(300 + i, "rarepair a@b.co") for i in range(10)]  # copies of one entity are no support
    df = frame(spark, rows)
    found = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(df, pii.with_base(df), disclosed=0.0).collect()}
    assert found["contactperson"] == pytest.approx(1.0) and "rarepair" not in found and found["call"] < 0.2
    clean = {r["doc_id"]: r for r in pii.sanitised(df).collect()}
    assert clean[3]["text"] == "noise words here 3 and call [TERM] [PHONE] okay noise" and clean[300]["text"] == "rarepair [EMAIL]"
    assert clean[100]["text"] == rows[30][1] and clean[3]["tid"] == 3 and set(clean[3].asDict()) == set(df.columns)
    gone = {r["doc_id"]: r["text"] for r in pii.sanitised(df, remove_terms=True).collect()}
    assert gone[3] == "noise words here 3 and call  [PHONE] okay noise"


def plain_ppm(texts, order):
    table = collections.defaultdict(collections.Counter)
    signs = lambda ws: [*["S"] * order, *" ".join(ws).encode(), "E"]
    for ws in texts:
        s = signs(ws)
        for i in range(order, len(s)):
            for k in range(order + 1):
                table[tuple(s[i - k : i])][s[i]] += 1

    def log10(ws):
        s, total = signs(ws), 0.0
        for i in range(order, len(s)):
            out = set()
            for k in range(order, -1, -1):
                seen = table.get(tuple(s[i - k : i]))
                left = {a: n for a, n in (seen or {}).items() if a not in out}
                if s[i] in left:
                    total += math.log10((left[s[i]] - 0.5) / sum(left.values()))
                    break
                if left:
                    total += math.log10(len(left) / 2 / sum(left.values()))
                out |= set(left)
            else:
                total += math.log10(1 / (language_model.SIGNS - len(out)))
        return total

    return log10


@pytest.mark.parametrize("order, piece", [(4, 4 << 20), (2, 37), (5, 6)])
def test_language_model_equals_plain_ppm(spark, monkeypatch, order, piece):
    rows = corpus(seed=5, n=30)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *EXTRA).repartition(3)
    got = language_model.scores(df.withColumn("held_out", W.fold_of(F.col("doc_id")) == 1), order=order).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    texts = [(i, words_of(lower(t))) for i, t in rows]
    counts = collections.Counter(w for i, ws in texts if not held(i) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    model = plain_ppm([ws for i, ws in texts if not held(i)], order)
    want = collections.Counter()
    for i, ws in texts:
        tokens = [*ws, None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, f"{base:.5g}", f"{model(ws):.4g}"] += 1
    assert collections.Counter((*r[:5], f"{r[5]:.5g}", f"{r[6]:.4g}") for r in got) == want
    # Texts cut into pieces have the grams and sums of texts in one piece.
    data, offsets = W.flat(pa.array([t for _, t in rows]))
    signs = language_model.signs_of(data, *W.words(data, offsets), order)
    train = np.arange(len(rows)) % 2 == 0
    grams, uses = language_model.counted(signs, train, order)
    sums = language_model.coded(signs, grams, np.arange(len(grams), dtype=float), len(rows), order)
    monkeypatch.setattr(language_model, "PIECE", piece)
    again, uses2 = language_model.counted(signs, train, order)
    assert (again == grams).all() and (uses2 == uses).all() and uses.sum() == sum(
        len(" ".join(words_of(t or "")).encode()) + 1 for _, t in rows[::2])
    assert language_model.coded(signs, grams, np.arange(len(grams), dtype=float), len(rows), order) == pytest.approx(sums)


def test_order_of_words_counts(spark):
    """Contexts run over a word's end: a text is likelier than its words in reverse."""
    rows = [(i, "the cat sat on the mat and the dog lay on the rug") for i in range(20)]
    rows += [(100, "the dog sat on the rug"), (101, "rug the on sat dog the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 100)
    got = {r["doc_id"]: r for r in language_model.scores(df).collect()}
    assert got[100]["score"] > got[101]["score"] + 3 and got[100]["base_score"] == pytest.approx(got[101]["base_score"])


def test_rare_words_are_learned_beside_many_signs(spark):
    """A text of more than 2^21 signs does not push out what was seen once: a text costs what
    plain PPM says, with all counts."""
    rows = [(1, "kalo miru " * 300_000), (2, "zyxq vutw"), (3, "zyxq vutw")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") == 3)
    got = {r["doc_id"]: r["score"] for r in language_model.scores(df).collect()}
    cost = plain_ppm([["kalo", "miru"] * 300_000, ["zyxq", "vutw"]], language_model.ORDER)
    assert got[3] == pytest.approx(cost(["zyxq", "vutw"]), rel=1e-4) and got[2] == got[3]


def test_language_model_without_rows_or_training_texts(spark):
    df = frame(spark, [(1, "a b"), (2, None)]).withColumn("held_out", F.lit(True))
    got = language_model.scores(df).orderBy("doc_id").collect()
    signs = math.log10(language_model.SIGNS)
    assert [r["score"] for r in got] == pytest.approx([-4 * signs, -signs]) and got[0]["train_tokens"] == 0
    assert language_model.scores(df.limit(0)).count() == 0


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        left = share * sum(sizes.values()) - sum(capped.values())
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if want[s] > 2 * sizes[s]}
        if not over:
            return capped | want
        capped |= over


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice(["a", "a", "a", "b", "Z", "é", None]), rng.choice([None, "", "w " * rng.randint(1, 400)])) for i in range(400)]
    rows += [(7, "b", "same row"), (7, "b", "same row"), (1000, "a", "long " * 9_000), (1001, "empty", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", *EXTRA)
    got = [tuple(r) for r in mixing.mix(df.repartition(5)).collect()]
    again = [tuple(r) for r in mixing.mix(df.repartition(2)).collect()]
    assert collections.Counter(got) == collections.Counter(again) and len(got) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for doc, source, size, of_source, target, took in got:
        sizes[source] += size
        taken[source] += took
        assert took <= 2 * size
    want = plain_targets(sizes)
    assert all(g[3] == sizes[g[1]] and g[4] == pytest.approx(want[g[1]]) for g in got)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.filter("text is null")).count() == sum(r[2] is None for r in rows)


def test_every_stretch_of_the_mix_keeps_the_weights(spark):
    shares = {0: 40_960, 1: 20_480, 2: 102_400}
    targets = spark.createDataFrame(list(shares.items()), "no int, target_words long")
    slots = sorted((r["slot"], r["no"], r["k"], r["words"]) for r in mixing.schedule(targets, block=128).collect())
    total = sum(shares.values())
    assert {n: sum(w for _, m, _, w in slots if m == n) for n in shares} == shares
    assert all(sorted(k for _, m, k, _ in slots if m == n) == list(range(shares[n] // 128)) for n in shares)
    for end in range(64, len(slots), 64):
        for n, words in shares.items():
            mine = sum(m == n for _, m, _, _ in slots[:end])
            assert abs(mine - end * words / total) <= 8


def test_pieces_cover_what_is_taken(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i + 1)) for i in range(60)], "doc_id long, source string, text string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df, block=64).collect() if r["taken"]}
    pieces = collections.Counter()
    for r in mixing.mix(df, block=64, pieces=True).collect():
        assert 0 <= r["first"] < r["last"]
        pieces[r["doc_id"]] += r["last"] - r["first"]
    assert pieces == taken


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda k: " ".join(rng.choice("kalo miru sen tavo pelu hani doro".split()) + rng.choice("abcdefgh") for _ in range(k))
    rows = [(i, text(60), "en", "ab"[i % 2]) for i in range(120)]
    for i in range(0, 60, 3):
        rows[i] = (i, rows[i][1] + " grobbo fnarl", "en", "a")
    item = text(25)
    rows += [(200, rows[1][1], "en", "a"), (201, rows[2][1] + " end", "en", "b"), (202, text(10) + " " + item + " " + text(10), "en", "a"),
             (203, text(40) + " x.y@example.org " + text(3), "en", "b"), (204, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0 and i < 60)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in at.collect()}
    every = {r[0] for r in rows}
    assert every - set(seen["drop_toxic"]) == {i for i in range(0, 60, 3)}
    assert set(seen["drop_toxic"]) - set(seen["keep_one_of_group"]) == {200, 201}
    assert set(seen["keep_one_of_group"]) - set(seen["drop_contaminated"]) == {202}
    clean = seen["take_out_personal_data"]
    assert set(clean) == set(seen["drop_contaminated"]) and "[EMAIL]" in clean[203]["text"] and clean[203]["n_chars"] == len(clean[203]["text"])
    assert clean[204]["text"] is None and set(clean[203].asDict()) == set(corpus_pipeline.COLUMNS)
    assert set(seen["mix_sources"]) == set(clean) and sum(r["taken"] for r in seen["mix_sources"].values()) > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(clean)
