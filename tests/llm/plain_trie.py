"""The prefix trie by a plain walk over dictionaries."""

import hashlib
import re
import zlib


def rebuilt(rows, group=20, most=4):
    """conv_id -> list of (role, text), from rows (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            # turns with the same number go by role, then by the digest that stands for them
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            found.setdefault(conv, []).append((turn is not None, turn or 0, role, tie, text))
    original = {c: [(role, text) for *_, role, _, text in sorted(turns)] for c, turns in found.items()}
    return {
        c: original.get(c - c % group, [])[:h] + turns[h:]
        for c, turns in original.items()
        for h in [zlib.crc32(str(c).encode()) % most]
    }


def nodes(rows):
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    members = {}
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * words
        if path:
            up = path[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[path]
            saved[up] = saved.get(up, 0) + saved[path]
    result = []
    for path, found in members.items():
        ends = sorted(c for c in found if len(convs[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        result.append((min(found), len(path), parent, len(found), children.get(path, 0), leaves[path], saved[path], digest))
    return result
