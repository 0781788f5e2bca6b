"""Small tables that the tests share."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kid string, id string, words string, kept string, n string, label string, start string"


def rows_of(pairs):
    """Rows of (doc_id, text) with more columns whose names the operators use themselves."""
    return [(i, t, "en", "s", len(t or ""), "k", "i", "w", "x", "n", "l", "s") for i, t in pairs]


MESSY = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a  b c d e f g "), (7, "x" * 70_000), (8, "wörd 你好   😀 \x1c end " * 3), (None, "a b c d e f g"), (None, None), (9, "a b c d e f h"), (10, "the cat sat on the mat " * 400)]


def random_docs(seed, count, alphabet, low, high, copies=0.3):
    """Short texts over few symbols, some of them partly copied from earlier ones."""
    r, docs = random.Random(seed), []
    for _ in range(count):
        text = [r.choice(alphabet) for _ in range(r.randint(low, high))]
        if docs and r.random() < copies:
            other = r.choice(docs)
            a = r.randint(0, len(other))
            at = r.randint(0, len(text))
            text[at:at] = other[a : a + r.randint(1, max(1, len(other)))]
        docs.append(text)
    return docs


BASE = {
    0: re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    1: re.compile(r"AKIA[A-Z0-9]+"),
    2: re.compile(r"[0-9a-f]+"),
}


def base_of(text):
    keep = {0: lambda m: len(m[2]) >= 12, 1: lambda m: len(m[0]) >= 18, 2: lambda m: len(m[0]) >= 16}
    return sorted((m.start(), k, m.end()) for k, p in BASE.items() for m in p.finditer(text) if keep[k](m))
