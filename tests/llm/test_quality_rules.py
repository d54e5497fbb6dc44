import random
import re
from collections import Counter

from pyspark.sql import functions as F

from linkscore.llm import quality_rules as Q


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)})
    return (
        len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)),
        repeats, len(w) < 50 or 100 * repeats > 50 * len(w),
    )


def test_base_statistics_against_brute_force(make_docs):
    random.seed(2)
    texts = [None, "", " \n\t", "a", "a b a", "a b c a b c", "x\r\nx\n\nx", "é b #<>", "a a a a a"]
    for _ in range(150):
        words = random.choices(["a", "b", "the", "of", "#x", "Zé", "|"], k=random.randint(1, 90))
        texts.append("".join(w + random.choice([" ", "\n", "  ", "\t", "\x0b"]) for w in words))
    texts += ["w" * 5000 + " x" * 20000, texts[-1]]
    docs = make_docs(*texts).withColumn("votes", F.lit("clash")).withColumn("kept", F.lit(1))
    out = {r["doc_id"]: r for r in Q.judge_quality(docs).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        r = out[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base(text), (i, text)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_estimation_finds_the_planted_accuracies():
    random.seed(3)
    n = len(Q.RULES)
    counts, truth = Counter(), {}
    for _ in range(5000):
        good = random.random() < 0.8
        chance = 0.9 if good else 0.15
        p = "".join(random.choices("+-0", [chance, 1 - chance, 0.3])[0] for _ in range(n))
        counts[p] += 1
        truth.setdefault(p, []).append(good)
    posterior = Q.fit_accuracies(dict(counts))
    right = sum((posterior[p] >= 0.5) == g for p, gs in truth.items() for g in gs)
    assert right / 5000 > 0.98


def test_junk_goes_and_prose_stays(make_docs):
    random.seed(4)
    prose = [" ".join(random.choices("the of and river stone walked into house light many from".split(), k=80)) for _ in range(40)]
    prose = [re.sub(r"(\w+) (\w+)", lambda m: f"{m[1]}{random.randint(0, 9)} {m[2]}", p) for p in prose]
    junk = [" ".join(f"w{random.randint(0, 99)}###" for _ in range(80)) for _ in range(8)]
    out = {r["doc_id"]: r["kept"] for r in Q.judge_quality(make_docs(*prose, *junk)).collect()}
    assert all(out[i] for i in range(40)) and not any(out[i] for i in range(40, 48))


def test_empty_table(make_docs):
    assert Q.judge_quality(make_docs("x").filter("false")).collect() == []
