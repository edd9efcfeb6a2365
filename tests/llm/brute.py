"""Plain descriptions of the corpus operators' results, for small inputs."""

import hashlib
import re
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = SPACED.findall(text)
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard_roots(rows, threshold=0.8):
    """{index: some name of its class} of (doc_id, text) rows."""
    usable = [(i, t) for i, (d, t) in enumerate(rows) if d is not None and t is not None]
    found = jaccard_classes(usable, threshold)  # the least index names a class
    return {i: i for i in range(len(rows))} | {i: found[k][0] for k, (i, _) in enumerate(usable)}


def jaccard_classes(rows, threshold=0.8):
    """{index: (class id, links, copies)} of (doc_id, text) rows."""
    texts = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        if doc_id is not None and text is not None:
            texts[tuple(SPACED.findall(text))].append(i)
    keys = list(texts)
    sets = [shingles(" ".join(k)) for k in keys]
    links, parent = defaultdict(set), list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
                parent[root(a)] = root(b)
    least = {}
    for a, k in enumerate(keys):
        ids = [rows[i][0] for i in texts[k]]
        least[root(a)] = min([*ids, least.get(root(a), ids[0])])
    out = {i: (doc_id, 0, 1) for i, (doc_id, _) in enumerate(rows)}
    for a, k in enumerate(keys):
        for i in texts[k]:
            out[i] = (least[root(a)], len(links[a]), len(texts[k]))
    return out


def license_spans(text, templates, least=0.8):
    """(license, first word, end word, containment) of one text, from every place of every template."""
    words = ALNUM.findall(ascii_lower(text))
    found = []
    for name, template in templates.items():
        own = ALNUM.findall(ascii_lower(template))
        width = min(5, len(own))
        if not width:
            continue
        parts = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}
        span = max(len(own) - 4, 1)
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        all_of_it = []
        for a, gram in enumerate(grams):
            if gram in parts:
                inside = [i for i in range(a, min(a + span, len(grams))) if grams[i] in parts]
                share = len({grams[i] for i in inside}) / len(parts)
                if share >= least:
                    all_of_it.append((-share, a, inside[-1] + width))
        chosen = []
        for share, a, b in sorted(all_of_it):
            if all(b <= c or d <= a for _, c, d in chosen):
                chosen.append((share, a, b))
        found += [(share, a, name, b) for share, a, b in chosen]
    out = []
    for share, a, name, b in sorted(found):
        if not any(2 * (min(b, d) - max(a, c)) > max(b - a, d - c) for _, c, d, _ in out):
            out.append((name, a, b, -share))
    return sorted(out, key=lambda f: (f[1], f[0]))


def contamination(text, items, span=13):
    """n_words, n_hit, items of one document; ``items`` is a list of (id, text)."""
    words = ALNUM.findall(ascii_lower(text))
    covered, found = set(), set()
    for item_id, item in items:
        own = ALNUM.findall(ascii_lower(item))
        n = min(span, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                covered.update(range(i, i + n))
                found.add("" if item_id is None else str(item_id))
    return len(words), len(covered), sorted(found)


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def base_spans(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
