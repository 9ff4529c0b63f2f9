"""Plain Python definitions the Spark operators are compared with."""


def jaro(a, b):
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m = len(left)
    moved = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3
