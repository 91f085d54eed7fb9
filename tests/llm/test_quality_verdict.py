"""The verdict of the quality rules, word by word."""

import random
import re
from collections import Counter

from tideline.llm import quality

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """repeat_share, line_share, kept."""
    words = WORD.findall(text or "")
    if not words:
        return 0.0, 0.0, False
    chars, share, over, failed = sum(map(len, words)), 0.0, False, len(words) < 10
    for n, limit in quality.NGRAM_LIMITS.items():
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        many = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(n)}
        part = sum(len(words[i]) for i in covered) / chars
        share, over = max(share, part), over or part > limit
        failed = failed or n == 5 and 100 * len(covered) > 20 * len(words)
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    repeated = sum(n * sum(map(len, WORD.findall(x))) for x, n in lines.items() if n > 1) / chars
    symbols = sum(c in "#*$%&|<>" for c in text)
    letters = [w for w in words if len(w.encode()) > 1 and w.upper() != w.lower()]
    ascii_upper = lambda w: w.encode().upper() == w.encode()
    letters = [w for w in letters if w.encode().upper() != w.encode().lower()]
    shout = sum(map(ascii_upper, letters)) / max(1, len(letters)) if len(words) >= quality.CAPS_WORDS else 0
    kept = not (failed or over or repeated > quality.LINE_LIMIT or symbols > quality.SYMBOL_LIMIT * len(words) or shout > quality.CAPS_LIMIT)
    return share, repeated, kept


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "one two", "A LOUD TEXT THAT SHOUTS ALL OF ITS TEN OR MORE WORDS", "# * $ % & words | < > and # # # # # # # # more"]
    for k in range(120):
        words = [rng.choice(["ab", "cd", "é", "Xyz", "longer", "w%d" % rng.randrange(40 + 30 * (k % 9))]) for _ in range(rng.randrange(5, 120))]
        if k % 3 == 0:
            words[3:3] = words[: rng.randrange(4, 20)]
        if k % 4 == 0:
            words = [x for w in words for x in (w, rng.choice(["\n", " "]))]
        text = " ".join(words)
        out.append(text + ("\n" + text.split("\n")[0]) * rng.randrange(3))
    return out


def test_verdicts(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    verdicts = Counter()
    for r in quality.quality_rules(docs).select("text", "quality.*").collect():
        share, lines, kept = plain(r.text)
        assert abs(r.repeat_share - share) < 1e-12 and abs(r.line_share - lines) < 1e-12 and r.kept == kept, r.text
        verdicts[kept] += 1
    assert min(verdicts[True], verdicts[False]) > 20
