"""Plain versions of the operators, one text at a time, to hold them against."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text, fold=True):
    text = text or ""
    return SPACED.findall(text.translate(FOLD) if fold else text)


def alnum(text):
    return ALNUM.findall((text or "").translate(FOLD))


def shingles(text, k=5):
    w = spaced(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def components(docs):
    """docs: (doc_id, text) with distinct ids -> {doc_id: smallest id reachable}."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def contaminated(text, items, span=10):
    """(words, hit words, items) of one text against (item_id, text) items."""
    words = alnum(text)
    hit, found = set(), set()
    for item, body in items:
        w = alnum(body)
        n = min(span, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for at in range(len(words) - n + 1) if n else ():
            if tuple(words[at : at + n]) in windows:
                hit.update(range(at, at + n))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def quality(text):
    text = text or ""
    words = spaced(text, fold=False)
    chars = sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for c in text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), chars, symbols, dup, len(covered), failed


def quality_keeps(text):
    """The method's verdict on a text that the base rule does not fail."""
    text = text or ""
    n, chars, symbols, dup, _, _ = quality(text)
    words = spaced(text, fold=False)
    digits = sum(c in "0123456789" for c in text)
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    lines = sum(bool(SPACED.search(line)) for line in text.split("\n"))
    bad = 10 * symbols > 3 * n or chars < 2 * n or chars > 25 * n or 10 * digits > 6 * chars or 10 * doubled > 3 * n
    return not (bad or (lines >= 4 and 10 * dup > 4 * lines))


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))


def base_places(text):
    words = alnum(text)
    return len(words), sorted((i, label) for phrase, label in PHRASES for i in range(len(words) - len(phrase) + 1) if tuple(words[i : i + len(phrase)]) == phrase)
