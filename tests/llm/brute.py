"""Plain single-process versions of the operators, for small inputs."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingles(text, width):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(docs, width, percent):
    """doc_id -> smallest doc_id in reach, by comparing every pair that shares a shingle."""
    sets = {d: shingles(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    held = {}
    for d, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(d)
    seen = set()
    for group in held.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * len(sets[a] | sets[b]):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def crc_of_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def encode(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
