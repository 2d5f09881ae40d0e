"""Plain single-machine versions of the operators, and small tables that try their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows():
    """(doc_id, text) with nulls, empty and long texts, ties, repeats and near-copies."""
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gamma", "DELTA", "épée", "zeta-9", "x", "lambda."]
    long_text = " ".join(rnd.choice(words) + str(rnd.randint(0, 3000)) for _ in range(6000))
    near = long_text.split(" ")
    near[17] = "changed"
    rows = [
        (1, long_text), (2, " ".join(near)), (3, long_text.upper()), (4, ""), (5, None), (6, " \t\n "), (7, "one"), (8, "One"),
        (9, "one two"), (10, "a" * 300), (11, "a" * 300), (12, "ab" * 400), (13, "<|endoftext|> and more <|endoftext|>"),
        (14, "line one is here\nline one is here\nline two\n\nLine one  is here"), (14, "another text of the same id"),
        (15, "mail me at bob.x+y@ex-ample.co.uk or +1 (555) 555-0100, card 4111 1111 1111 1111, host 10.2.3.4 and 1.2.3.400"),
        (15, "mail me at bob.x+y@ex-ample.co.uk or +1 (555) 555-0100, card 4111 1111 1111 1111, host 10.2.3.4 and 1.2.3.400"),
        (None, "a row without an id that has more than fifty bytes in its only line"), (None, None),
        (16, "\x00nul é 😀 \x85 \xa0 wide　space"),
    ]
    rows += [(20 + k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for k in range(40)]
    return rows


def odd_documents(spark, rows=None):
    """The rows as documents, with columns whose names the operators use themselves."""
    rows = odd_rows() if rows is None else rows
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, row long, block int, "
        "part int, kept boolean, own_id long, whole string, keep_id long, rank long, length long, bucket long, host string"
    )
    full = [
        (i, t, "en" if (i or 0) % 2 else None, None if i == 7 else "src", len(t or ""), "d", 1, 2, 3, 4, None, 5, "w", 6, 7, 8, 9, "h")
        for i, t in rows
    ]
    return spark.createDataFrame(full, schema).repartition(3)


def simhash(text, n=3):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
    )


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}", kind))
    return [(kind, text_) for _, _, text_, kind in sorted(found)]


def without_repeats(rows, width=50):
    """(doc_id, bytes, removed, spans, digest of the rest) of each row."""
    last = float("inf")
    texts = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - width + 1):
            first[b[p:p + width]] = min(i, first.get(b[p:p + width], last))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < i:
                gone[p:p + width] = b"\1" * width
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        out.append((None if i == last else i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def piece_rows(ids, size=1024):
    first = (len(ids) - 1) % size + 1
    edges = [0, *range(first, len(ids) + 1, size)]
    packed = [k.to_bytes(4, "little") for k in ids]
    return [(k, a, b - a, zlib.crc32(b"".join(packed[a:b]))) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
