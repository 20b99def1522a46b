"""Small corpora and brute-force versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOC = "doc_id long, text string, source string, extra string, uid long, h long, rank int"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty, short and long texts, and clashing column names."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, texts = text(60), []
    for i in range(n):
        kind = i % 10
        if kind < 4 or not texts:
            t = text(r.randint(1, 150))
        elif kind == 4:
            t = r.choice(texts)
        elif kind == 5:
            w = r.choice(texts).split(" ")
            w[r.randrange(len(w))] = "changed"
            t = "\n".join(w)
        elif kind == 6:
            t = text(20) + " " + passage + "\t" + text(r.randint(0, 30))
        elif kind == 7:
            t = " ".join([text(r.randint(1, 6))] * 30)
        elif kind == 8:
            t = r.choice(["", " \t", "One", "a b c d", "A B C D", "😀 x"])
        else:
            t = r.choice(texts).upper()
        texts.append(t)
    rows = [(i, t, r.choice(["a", "b", "Ä", "a", "a"]), "x", 1, 2, 3) for i, t in enumerate(texts)]
    rows.append((n, None, None, None, None, None, None))
    rows.append((n + 1, "word " * 4000 + text(4000), "b", None, None, None, None))
    return rows


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def rows(df, *names):
    return {r[0]: tuple(r[1:]) for r in df.select(*names).collect()}
