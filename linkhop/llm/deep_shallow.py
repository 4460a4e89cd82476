"""Deep-shallow sorting of byte strings, and the repeats that a group of passages shares."""

from __future__ import annotations

from bisect import bisect_left

#: Bytes to which multikey quicksort sorts before blind tries take over, and bytes compared at once.
SHALLOW, STEP = 96, 8


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; `known` bytes are known to agree."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while lo < hi:  # a[:lo] agrees
        mid = (lo + hi) // 2
        if a[lo : mid + 1] == b[lo : mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo


def blind_trie(strings: list[bytes], group: list[int], depth: int, order: list[int], lcp: list[int], first: int) -> None:
    """Appends the group, which agrees on `depth` bytes, in order; lcp of its first entry is `first`.

    Inner nodes hold a depth and one child a byte (-1: the string ends); a string is led
    down by the branching bytes alone, compared once with the leaf it meets, and hung in
    where the two part.
    """

    def at(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    root: list | tuple = ("leaf", [group[0]])
    for x in group[1:]:
        s, node = strings[x], root
        while node[0] != "leaf":
            node = node[1].get(at(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        n = common(s, other, depth)
        if n == len(s) == len(other):
            node[1].append(x)
            continue
        above, node = None, root
        while node[0] != "leaf" and node[0] < n:
            above, node = node, node[1][at(s, node[0])]
        if node[0] == n:
            node[1][at(s, n)] = ("leaf", [x])
            continue
        split = (n, {at(other, n): node, at(s, n): ("leaf", [x])})
        if above is None:
            root = split
        else:
            above[1][at(s, above[0])] = split
    stack: list[tuple] = [(root, first)]
    while stack:
        node, before = stack.pop()
        if node[0] == "leaf":
            for i, x in enumerate(node[1]):
                order.append(x)
                lcp.append(len(strings[x]) if i else before)
        else:
            kids = [node[1][c] for c in sorted(node[1])]
            stack += [(kid, node[0] if i else before) for i, kid in reversed(list(enumerate(kids)))]


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of the strings, and each one's common prefix with the one before it (0 for the first)."""
    order: list[int] = []
    lcp: list[int] = []
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, first = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            lcp.append(first)
        elif depth >= SHALLOW:
            blind_trie(strings, group, depth, order, lcp, first)
        elif group:
            # multikey quicksort on the next bytes
            pivot = strings[group[len(group) // 2]][depth : depth + STEP]
            less, same, more = [], [], []
            for x in group:
                key = strings[x][depth : depth + STEP]
                (less if key < pivot else more if key > pivot else same).append(x)
            if len(pivot) < STEP:  # all of same end here
                parts = [(less, depth), (same, SHALLOW), (more, depth)]
            else:
                parts = [(less, depth), (same, depth + STEP), (more, depth)]
            parts = [p for p in parts if p[0]]
            # the first entry of a part is compared with the last of the part before once both are placed
            stack += [(g, d, first if i == 0 else -1) for i, (g, d) in reversed(list(enumerate(parts)))]
    for i, n in enumerate(lcp):
        if n < 0:
            lcp[i] = common(strings[order[i - 1]], strings[order[i]])
    return order, lcp


def shared_stretches(passages: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For passages (data, anchor) that meet at their anchors: the stretches [from, to) of each that
    one other passage shares in line with the anchor and that have at least `length` bytes.

    What two passages share is L bytes left and R bytes right of the anchor.  Passages are
    joined by falling R along the sorted right sides; of each join only the neighbours in
    the order of the left sides matter, as any other pair is outdone by a pair joined
    before or by a neighbour.
    """
    n = len(passages)
    out: list[list[tuple[int, int]]] = [[] for _ in passages]
    right_order, right_lcp = deep_shallow([d[a:] for d, a in passages])
    left_order, left_lcp = deep_shallow([d[:a][::-1] for d, a in passages])
    left_rank = [0] * n
    for r, x in enumerate(left_order):
        left_rank[x] = r
    owner = list(range(n))
    members = [[left_rank[x]] for x in range(n)]  # left ranks, ascending

    def find(x: int) -> int:
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    def meet(r: int, q: int, right: int) -> None:
        """The passages with left ranks r and q agree on `right` bytes from the anchor."""
        lo, hi = (r, q) if r < q else (q, r)
        left = min(left_lcp[lo + 1 : hi + 1])
        if left + right >= length:
            for x in (left_order[r], left_order[q]):
                a = passages[x][1]
                out[x].append((a - left, a + right))

    for i in sorted(range(1, n), key=lambda i: -right_lcp[i]):
        right = right_lcp[i]
        if right == 0:
            break
        a, b = find(right_order[i - 1]), find(right_order[i])
        if len(members[a]) < len(members[b]):
            a, b = b, a
        big = members[a]
        for r in members[b]:
            p = bisect_left(big, r)
            if p:
                meet(r, big[p - 1], right)
            if p < len(big):
                meet(r, big[p], right)
        big += members[b]
        big.sort()
        owner[b] = a
    return out
