"""Plain and slow versions of what the operators compute, for small tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import xxhash

from closetlake.llm.mixing import OP3_SQL


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size, fold=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text) if fold else text or "")
    return [tuple(words[k: k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def connected(sets, times, of):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if not a or not b or min(len(a), len(b)) * of < max(len(a), len(b)) * times:
                continue
            both = len(a & b)
            if both * of >= (len(a) + len(b) - both) * times:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def tiled(item, doc, least=5):
    """Words of the item that greedy tiles of the document cover."""
    least = min(least, len(item))
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
    where = Counter()
    at = {}
    for j, w in enumerate(doc):
        at.setdefault(w, []).append(j)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in at.get(item[i], ()):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        free_i[i: i + n] = [False] * n
        free_d[j: j + n] = [False] * n
        covered += n
        where[i] += 1


def license_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k: k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), places, labels


def _x(data, seed):
    return xxhash.xxh64_intdigest(data, seed=seed)


def fingerprint(text, bins=128):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    h = [_x(w.encode(), 42) for w in words]
    if not h:
        return ""
    if len(h) < 5:
        found = [_x(" ".join(str(signed(v)) for v in h).encode(), 42)]
    else:
        found = []
        for k in range(len(h) - 4):
            seed = 42
            for v in h[k: k + 5]:
                seed = _x(struct.pack("<Q", v), seed)
            found.append(seed)
    full = {}
    for v in found:
        b = v >> 57
        full[b] = min(full.get(b, v), v)

    def lent(b):
        start = _x(b"densify", 42)
        return min(full, key=lambda c: (signed(_x(struct.pack("<i", c), _x(struct.pack("<i", b), start))), c))

    return "".join(f"{full.get(b, full[lent(b)] if b not in full else 0) & 255:02x}" for b in range(bins))


def extendible(rows, limit, prefix=""):
    total = sum(b for _, b in rows.values())
    if total <= limit or len(rows) <= 1:
        return dict.fromkeys(rows, prefix)
    out = {}
    for bit in "01":
        part = {i: r for i, r in rows.items() if r[0][len(prefix)] == bit}
        if part:
            out |= extendible(part, limit, prefix + bit)
    return out


def mixed_copies(docs):
    con = duckdb.connect()
    frame = pd.DataFrame(docs)[["doc_id", "text", "source"]]
    con.register("documents", frame)
    got = con.execute(OP3_SQL).fetchall()
    return {i: int(taken / max(1, size) + 0.5) for i, size, _, _, taken in got}


def spelling_words(docs):
    """How often each word occurs, over (doc_id, text)."""
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 7:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 2}


def spelling_variants(n):
    """(word, form, root, n, n_near, form_n) of every word, by patterns with one place left out."""
    patterns = {}
    for w in n:
        for k in range(len(w)):
            patterns.setdefault(w[:k] + "\0" + w[k + 1:], []).append(w)
    near = {w: set() for w in n}
    for pattern, found in patterns.items():
        for a in found:
            near[a].update(b for b in found if b != a)
            if (short := pattern.replace("\0", "")) in n:
                near[a].add(short)
                near[short].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def trie(sequences):
    """Nodes of the prefix trie over {conv_id: [(role, text), ...]} as rows in the order of the operator's columns."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, found in members.items():
        own = (len(found) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own
    out = set()
    for p, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(sequences[c]) == len(p))
        out.add((min(found), len(p), min(members[p[:-1]]) if p else None, len(found), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(own):
    """Conversations with their first turns taken from the one at the multiple of five below."""
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def vector_links(rows, cosine):
    """{row number: (links, smallest row number reachable)} of rows (vector, label)."""
    units = [None if v is None or label is None or not len(v) or not np.isfinite(np.array(v, float)).all() or not np.any(v)
             else np.array(v, float) / np.linalg.norm(np.array(v, float)) for v, label in rows]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][1] == rows[b][1] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            todo += [x for x in links[todo.pop()] if not (x in seen or seen.add(x))]
        out[a] = (len(links[a]), min(seen))
    return out


def chain_marginals(evidence, trans):
    """Probability of label 1 at each position of one sequence, by forward and backward sums of plain weights."""
    n = len(evidence)
    ahead, back = [], [(1.0, 1.0)] * n
    for k, e in enumerate(evidence):
        own = (1.0, math.exp(max(-60.0, min(60.0, e))))
        before = ahead[-1] if k else None
        row = [own[j] * (sum(before[i] * math.exp(trans[i][j]) for i in (0, 1)) if k else 1.0) for j in (0, 1)]
        ahead.append([x / sum(row) for x in row])
    for k in range(n - 2, -1, -1):
        own = (1.0, math.exp(max(-60.0, min(60.0, evidence[k + 1]))))
        row = [sum(math.exp(trans[i][j]) * own[j] * back[k + 1][j] for j in (0, 1)) for i in (0, 1)]
        back[k] = [x / sum(row) for x in row]
    return [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back)]


def curve(inputs, weights):
    z = sum(x * w for x, w in zip(inputs, weights[:-1])) + weights[-1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def toxic_text(text, model, hash_of, buckets, sequence):
    """Score and spans of one text, token by token."""
    tokens, start, lines = [], None, 0
    for k, c in enumerate((text or "") + "\n"):
        if (c.isascii() and c.isalnum()) or ord(c) >= 128:
            start = k if start is None else start
        else:
            if start is not None:
                tokens.append((lines, start, k, lower(text[start:k])))
                start = None
            lines += c == "\n"
    tagged, at = [], 0
    while at < len(tokens):
        part = [t for t in tokens[at: at + sequence] if t[0] == tokens[at][0]]
        own = [[int(h) % (buckets - 1) for h in hash_of(t[3])] for t in part]
        evidence = []
        for k, row in enumerate(own):
            slots = [*row, own[k - 1][0] if k else buckets - 1, own[k + 1][0] if k + 1 < len(own) else buckets - 1]
            evidence.append(model.field.bias + sum(model.field.weights[s][f] for s, f in enumerate(slots)))
        tagged += chain_marginals(evidence, model.field.trans)
        at += len(part)
    expected = sum(tagged)
    score = curve([math.log1p(expected), max(tagged, default=0.0), math.log1p(100 * expected / max(1, len(tagged)))], model.curve)
    spans, last = [], None
    for k, p in enumerate(tagged):
        if p >= 0.5:
            if last == k - 1 and spans:
                spans[-1] = (spans[-1][0], tokens[k][2])
            else:
                spans.append((tokens[k][1], tokens[k][2]))
            last = k
    return score, spans, tagged


def quality_text(text, model, steps):
    """Score, lines and bad lines of one text, line by line."""
    if not text:
        return model.share, 0, 0
    shares, ratios = [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7], [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    place = lambda x, edges: sum(e < x for e in edges)
    rows, sizes, held, lines = [], [], set(), text.split("\n")
    for k, line in enumerate(lines):
        raw = line.encode("utf-8", "surrogatepass")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
        n, size = len(words), len(raw)
        kinds = [sum(65 <= b <= 90 for b in raw), sum(b in b"#$%&*@|<>{}[]=~^_\\/+" for b in raw), raw.count(b"!"), sum(48 <= b <= 57 for b in raw)]
        seen = 2 if k and line == lines[k - 1] else int(line in held)
        held.add(line)
        rows.append([
            min(steps - 2, int(math.log2(max(1, size)))), min(steps - 2, int(math.log2(max(1, n)))),
            place(len(set(words)) / max(1, n), ratios) if n >= 10 else steps - 2, place(sum(a == b for a, b in zip(words, words[1:])) / max(1, n), shares),
            *[place(x / max(1, size), shares) for x in kinds], min(steps - 2, int(size / max(1, n) / 3)), seen])
        sizes.append(size + 1)
    none = [steps - 1] * len(rows[0])
    evidence = []
    for k, row in enumerate(rows):
        slots = row + (rows[k - 1] if k else none) + (rows[k + 1] if k + 1 < len(rows) else none)
        evidence.append(model.field.bias + sum(model.field.weights[s][f] for s, f in enumerate(slots)))
    good = chain_marginals(evidence, model.field.trans)
    inputs = []
    for x in (sum(g * s for g, s in zip(good, sizes)) / sum(sizes), min(good)):
        x = min(max(x, 1e-4), 1 - 1e-4)
        inputs.append(math.log(x / (1 - x)) / 4)
    return curve(inputs, model.curve), len(lines), sum(g < 0.5 for g in good)


def language_of(text, model, bucket_of):
    """Predicted language and its probability, letter by letter and codeword by codeword."""
    small = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    letters = [small(c) if c.isalpha() else 0 for c in f" {text or ''} "]
    at = [k for k, x in enumerate(letters) if x]
    if not at:
        return "und", 0.0
    margins = [0.0] * model.weights.shape[1]
    for k in at:
        here, left, right = letters[k], letters[k - 1], letters[k + 1]
        two = (left << 21) | here
        for gram in (here, two | 1 << 62, (((right << 42) & (1 << 64) - 1) ^ two) | 1 << 63):
            row = model.weights[bucket_of(gram)]
            margins = [m + float(w) for m, w in zip(margins, row)]
    margins = [m / (3 * len(at)) + float(b) for m, b in zip(margins, model.bias)]
    loss = [len(code) * sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(trust, margins, code)) for trust, code in zip(model.trust, model.codes)]
    near = [math.exp(-x) for x in loss]
    best = max(range(len(near)), key=near.__getitem__)
    return model.languages[best], near[best] / sum(near)
