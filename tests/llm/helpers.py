"""Fixtures of odd documents and brute-force counterparts."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def filler(n, seed):
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("w" + str(x % 5003))
    return " ".join(out)


def odd_rows():
    """Nulls, empty and white texts, ties, repeats, long and non-ASCII texts."""
    a, b, c = filler(200, 1), filler(120, 2), filler(90, 3)
    near = a.split()
    near[100] = "changed"
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, " ".join(near), "en", "s2"), (4, None, None, None), (5, "", "en", ""),
        (6, " \n\t ", "en", "s1"), (7, "one two three", "de", "s2"), (8, "one two three", "de", None), (9, c + "\n" + b + " tail", "fr", "s1"),
        (10, "x " * 3 + b, "fr", "s3"), (10, "x " * 3 + b, "fr", "s3"), (11, "eé ü 漢字 🙂 end\x1cpart wide", "de", "s3"), (12, filler(30000, 4), "en", "s1"),
        (13, "line a\nline b\nline a\n\nline a  \n" * 5, "en", "s2"), (14, "it's  we'll   <|endoftext|> 12345  \n\n  x", "en", "s2"), (15, "y" * 5000, "en", "s3"),
        (16, "\n".join(filler(12, 9 + k % 2) for k in range(8)), "en", "s3"), (-3, b + " extra", "en", "s2"),
    ]
    return [(*r, 7, "clash") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string"


def write_tables(spark, path, rows, pages=None, labels=None):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(pages or [], "page_id long, url string, html string, name string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0
