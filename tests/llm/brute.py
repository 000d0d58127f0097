"""Plain versions shared by tests."""


def grams(text, k=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def components_of_texts(texts: dict) -> dict:
    """Smallest id that each id reaches over pairs with Jaccard >= 0.75 of their 5-word shingles."""
    sets = {i: grams(t) for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    label = {}
    for start in sorted(sets):
        todo = [start] if start not in label else []
        while todo:
            x = todo.pop()
            if x in label:
                continue
            label[x] = start
            common = {}
            for g in sets[x]:
                for y in holders[g]:
                    common[y] = common.get(y, 0) + 1
            todo += [y for y, n in common.items() if y not in label and 100 * n >= 75 * (len(sets[x]) + len(sets[y]) - n)]
    return label
