"""The operators' results by plain loops, for small tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "[\x20\x09-\x0d]"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def folded_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def quality(text):
    own, text = words(text), text or ""
    windows = {}
    for i in range(len(own) - 7):
        windows.setdefault(tuple(own[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    n_symbols = sum(c in "#*$%&|<>" for c in text)
    base = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return (
        len(own), sum(map(len, own)), n_symbols, len(lines) - len(set(lines)), len(covered),
        base, not base and 10 * n_symbols <= len(own),
    )


def overlap(text, items):
    """n_words, n_hit, n_items, items_sha256, contaminated; items as (item_id, text)."""
    own = folded_words(text)
    hit, found = set(), set()
    for item, of_item in items:
        theirs = folded_words(of_item)
        n = min(13, len(theirs))
        for i in range(len(theirs) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == theirs[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)


def shingles(text):
    own = words((text or "").translate(UPPER))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def near_components(rows):
    """doc_id to (size of the set, smallest reachable doc_id), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and 100 * both >= 85 * union and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def line_key(line):
    return re.sub(f"^{SPACE}+|{SPACE}+$", "", line).translate(UPPER)


def dedup_lines(rows):
    """(doc_id, lines, dropped, kept text) of each row."""
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line_key(line)
            if len(key) >= 10:
                owner[key] = min(i, owner.get(key, i))
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if owner.get(line_key(x), i) == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def chats(rows):
    """conv_id to (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        spoken = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(own), sha(spoken), len(loss), sha(loss))
    return out


def encoded(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
