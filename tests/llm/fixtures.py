"""Small tables with every awkward case, and plain-Python helpers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("id", "h", "keep_id", "group_size", "row", "node", "comp", "size", "key", "ledger", "failed", "spans", "__id", "__ledger", "none", "digest", "wordless")


def words(text):
    return WORD.findall(text or "")


def documents(seed=5, n=60):
    """``doc_id, text, lang, source, n_chars``: copies, near copies, shared
    passages, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéßñ") for _ in range(r.randint(2, 8))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(20, 120)))
        if i % 7 == 0:
            text = f"{text[:50]} {passage} {text[50:]}"
        if rows and i % 5 == 0:
            text = r.choice(rows)[1] or ""
        if rows and i % 6 == 0:
            near = words(r.choice(rows)[1] or "")
            if near:
                near[r.randrange(len(near))] = "Changed"
                text = "\t".join(near)
        rows.append((i, text, "en", f"src{i % 4}" if i % 9 else None, len(text)))
    rows += [
        (n, None, None, None, None), (n + 1, "", "en", "src1", 0), (n + 2, " \n\t ", "en", "src1", 4),
        (n + 3, "one two", "en", "src2", 7), (n + 4, "ONE two", "en", "src2", 7), (n + 5, "one\ntwo", "en", "zz", 7),
        (n + 6, " ".join(r.choice(vocabulary) for _ in range(5000)), "en", "src3", 1),
        (n + 7, "same words again " * 30, "de", "src0", 1), (n + 8, "$$ a ## b ** c && d %% e || f", "de", "src0", 1),
        (n + 9, "\x00  x y 😀 \x1c z", "de", "src0", 1),
    ]
    rows += [rows[3], rows[3]]  # repeated rows
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASH}) if clash else df


def shingle_sets(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, text, *_ in rows:
        w = words((text or "").translate(low))
        out.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def near_classes(rows):
    """Per row the smallest id reachable over links of similarity 0.75 or more."""
    sets = shingle_sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return [least.get(find(i)) for i in range(len(rows))], sets
