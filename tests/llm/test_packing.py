import random
from collections import Counter
from functools import lru_cache

from stratagraph.llm import packing


def fewest(items, capacity):
    """Brute force: fewest sequences."""
    items = tuple(sorted(items, reverse=True))

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        found = len(left)

        def fill(room, start, kept):
            nonlocal found
            found = min(found, 1 + best(kept))
            tried = set()
            for k in range(start, len(kept)):
                if kept[k] <= room and kept[k] not in tried:
                    tried.add(kept[k])
                    fill(room - kept[k], k, kept[:k] + kept[k + 1 :])

        fill(capacity - first, 0, rest)
        return found

    return best(items)


def test_patterns_hold_every_piece_once_and_fit():
    rnd = random.Random(1)
    for _ in range(300):
        capacity = rnd.choice([8, 20, 100, 2048])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 40) for _ in range(rnd.randint(0, 40))}
        found = packing.pack(counts, capacity)
        held = Counter()
        for pieces, times in found:
            assert times > 0 and sum(a * n for a, n in pieces) <= capacity
            for a, n in pieces:
                held[a] += n * times
        assert held == Counter(counts)
        rows = packing.slots(found)
        assert sum(last - first + 1 for _, first, _, _, _, last in rows) == sum(counts.values())


def test_reduction_loses_nothing():
    rnd = random.Random(2)
    for _ in range(400):
        capacity = rnd.choice([10, 12, 20])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))]
        fixed, left = packing.reduce(Counter(items), capacity)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(items, capacity), items
        assert sum(t for _, t in packing.pack(Counter(items), capacity)) <= fewest(items, capacity) + 1


def test_hot_length_is_one_pattern():
    found = packing.pack({1024: 10**9, 2048: 10**9, 3: 5}, 2048)
    assert len(found) <= 6 and sum(t for _, t in found) == 10**9 + 5 * 10**8 + 1
