"""Plain Python versions of the results, written from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def luhn(number: str) -> bool:
    values = [int(c) for c in reversed(number)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def private(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end) of the base spans."""
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 14 <= len(number) <= 19 and luhn(number) or kind == "phone" and 10 <= len(number) <= 15):
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def private_row(text: str | None) -> tuple:
    spans = private(text or "")
    count = lambda k: sum(s[2] == k for s in spans)
    return (*[count(k) for k in BASE], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)))


def fingerprint(text: str | None, n: int) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in BLANK.split(low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, prints: list[int], radius: int) -> list:
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least: dict = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [least.get(find(i)) for i in range(len(ids))]


def jaccard_components(texts: list, n: int) -> list[int]:
    """The smallest position that links at a similarity of 0.8 or more reach."""
    sets = []
    for text in texts:
        words = [w for w in BLANK.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets.append({tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))})
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def byte_encoding() -> tiktoken.Encoding:
    import base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact(rows: list[tuple]) -> dict:
    """(id, text) rows -> id: (keep_id, group_size, kept, sha256); ids are distinct."""
    groups: dict[str, list] = {}
    for name, text in rows:
        groups.setdefault(normal(text), []).append((-len(text or ""), name is None, name or 0, name))
    out = {}
    for text, members in groups.items():
        keep = min(members)[3]
        for *_, name in members:
            out[name] = (keep, len(members), name == keep, sha(text))
    return out


def digest(*parts: str) -> str:
    return sha("".join(parts))


def merkle_leaf(row: dict, text: str | None) -> str:
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def _levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def merkle(rows: list[dict]) -> list[tuple]:
    """doc_id, leaf, subroot, root, proof, folded root and whether it verifies, by whole lists."""
    def order(x):
        return (x is not None, x if x is not None else 0)

    groups: dict = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (order(r["doc_id"]), merkle_leaf(r, r["text"])))
        trees.append(_levels([merkle_leaf(r, r["text"]) for r in groups[s]]))
    top = _levels([t[-1][0] for t in trees])
    out = []
    for nth, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now, seen = merkle_leaf(r, text), []
            for tree, at in ((trees[nth], i), (top, nth)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3:at // 3 * 3 + 3]
                    k = at % 3
                    seen += run[:k] + run[k + 1:]
                    now, at = digest(*run[:k], now, *run[k + 1:]), at // 3
            out.append((r["doc_id"], trees[nth][0][i], trees[nth][-1][0], top[-1][0], digest(*seen), now, now == top[-1][0]))
    return out


def spelling(rows: list[tuple]) -> list[tuple]:
    """(word, form, root, n, n_near, form_n) of (doc_id, text) rows."""
    counts: dict[str, int] = {}
    for name, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            word = run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]
            counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = sorted(set("".join(counts)))
    near = {}
    for w in counts:
        edits = {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in ["", *letters]} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [x for x in edits - {w} if x in counts]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def unigram(rows: list[tuple]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text) rows."""
    made, counts = [], {}
    for name, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in BLANK.split(low) if w] + ["\n"]
        out = zlib.crc32(("" if name is None else str(name)).encode()) % 5 == 1
        made.append((name, out, words))
        if not out:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    total, types = sum(counts.values()), len(counts)
    return [(name, out, len(words), sum(w in counts for w in words), total,
             sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in words)) for name, out, words in made]
