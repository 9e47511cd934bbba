"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(text)
    if len(w) >= 5:
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return collections.Counter([tuple(w)] if w else [])


def similarity(a, b):
    inter = sum((a & b).values())
    return inter / max(1, sum(a.values()) + sum(b.values()) - inter)


def classes(rows, least=0.8):
    """doc_id -> smallest doc_id of its class, all pairs compared."""
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, t or "", shingles(t)) for i, t in rows]
    for k, (i, t, s) in enumerate(sets):
        for j, u, v in sets[:k]:
            if t == u or s and v and similarity(s, v) >= least:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def cut(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of what is left) per text."""
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def base_counts(text):
    text = text or ""
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def capacity(sizes, shards):
    """Smallest largest shard of contiguous groups."""

    def fits(c):
        n, now = 1, 0
        for x in sizes:
            if x > c:
                return False
            if now + x > c:
                n, now = n + 1, 0
            now += x
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def kneser_ney(rows, discounts):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    fold = lambda t: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 0]
    texts = [fold(t) for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    one, two = collections.Counter(), collections.Counter()
    for t, h in zip(texts, held):
        if not h:
            one.update(t)
            two.update(zip([None, *t[:-1]], t))
    n, v = sum(one.values()), len(one)
    context, follows = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (u, w), c in two.items():
        context[u][0] += c
        context[u][min(c, 3)] += 1
        follows[w] += 1
    d = discounts([sum(c == k for c in two.values()) for k in (1, 2, 3, 4)])
    e = discounts([sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)])
    types = sum(follows.values())
    left = sum(e[min(c, 3)] for c in follows.values()) / types
    out = []
    for t, h in zip(texts, held):
        base = full = 0.0
        for u, w in zip([None, *t[:-1]], t):
            p = (follows[w] - e[min(follows[w], 3)]) / types + left / (v + 1)
            if u in context:
                x, c = context[u], two[(u, w)]
                p = (c - d[min(c, 3)]) / x[0] + (d[1] * x[1] + d[2] * x[2] + d[3] * x[3]) / x[0] * p
            full += math.log10(p)
            base += math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1)))
        out.append((h, len(t), sum(one[w] > 0 for w in t), n, base, full))
    return out


def runs(w):
    """(start, length, period) of every run of a list of words, every lag tried."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if n >= max(24, 3 * q) and all(any(w[k] != w[k - p] for k in range(s + p, s + n)) for p in range(1, q)):
                out.append((s, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def with_period(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n, w = h // 10, len(w), list(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_row(doc_id, text):
    w = with_period(doc_id, words(text))
    found, gone = runs(w), set()
    for s, n, q in found:
        gone |= {*range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(w), len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def trie(turns, again):
    """(conv_id, depth, parent, convs, children, leaves, saved, digest of ends) of every node; ``turns`` are (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    lists = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in convs.items()}
    if again:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in lists}
        lists = {c: [*lists.get(c - c % 5, [])[: h[c]], *rows[h[c] :]] for c, rows in lists.items()}
    members = collections.defaultdict(list)
    for c in sorted(lists):
        for d in range(len(lists[c]) + 1):
            members[tuple(lists[c][:d])].append(c)
    out = collections.Counter()
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        leaves = sum(1 for x in under if not any(y[:-1] == x for y in under if y))
        ends = ",".join(str(c) for c in who if len(lists[c]) == len(node))
        children = sum(1 for x in under if len(x) == len(node) + 1)
        out[(who[0], len(node), members[node[:-1]][0] if node else None, len(who), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def page_texts(pages, min_pages):
    """page_id -> main text of (page_id, url, body) with plain templates: every subtree of every page is written out and counted by host.

    For pages of div, ul, li, p and article elements without attributes, entities or odd nesting.
    """
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self, text):
            super().__init__()
            self.stack = [["html", []]]
            self.feed(text)

        def handle_starttag(self, tag, attrs):
            self.stack[-1][1].append([tag, []])
            self.stack.append(self.stack[-1][1][-1])

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            self.stack[-1][1].append(data)

    def written(node):
        return " ".join(node.split()) if isinstance(node, str) else f"<{node[0]}>" + "|".join(map(written, node[1])) + "</>"

    def said(node):
        return bool(node.strip()) if isinstance(node, str) else any(map(said, node[1]))

    def below(node):
        for c in node[1]:
            if not isinstance(c, str):
                yield c
                yield from below(c)

    prose = lambda node: node[0] in ("p", "article") or any(x[0] in ("p", "article") for x in below(node))
    trees = {k: Tree(f"{body}").stack[0] for k, _, body in pages}
    host = {k: url.split("/")[2] for k, url, _ in pages}

    def evidence(node, inside):
        """What counts: all but prose in an article, what it stands in, and what stands in it."""
        for c in node[1]:
            if not isinstance(c, str) and not (inside or c[0] == "article") or not isinstance(c, str) and c[0] != "p":
                within = inside or c[0] == "article"
                if said(c) and not (within and prose(c)):
                    yield written(c)
                yield from evidence(c, within)

    # A subtree also counts where it decides: any one of a page without articles.
    seen = collections.Counter((host[k], w) for k, tree in trees.items() for w in {*evidence(tree, False)})
    out = {}
    for k, tree in trees.items():
        articles = [x for x in below(tree) if x[0] == "article"]
        template = lambda x: said(x) and seen[(host[k], written(x))] >= min_pages  # noqa: B023, E731
        blocks = []

        def read(node, edges, inside):
            for c in node[1]:
                if isinstance(c, str):
                    if c.strip():
                        blocks.append(" ".join(c.split()))  # noqa: B023
                elif not (any(c is e for e in edges) if inside else template(c)):  # noqa: B023
                    read(c, edges, inside)

        for article in articles:
            edges = []
            for children in (article[1], article[1][::-1]):
                for c in children:
                    if isinstance(c, str) and c.strip() or not isinstance(c, str) and said(c) and (prose(c) or not template(c)):
                        break
                    if not isinstance(c, str):
                        edges.append(c)
            read(article, edges, True)
        if not articles:
            read(tree, [], False)
        out[k] = "\n".join(blocks)
    return out
