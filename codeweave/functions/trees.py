"""Trees of skeletons and their edit distance."""

from __future__ import annotations


class Tree:
    """A preorder (depth, value) list under a synthetic root ``ROOT``, as child lists
    by level; no recursion, so depth is not limited."""

    def __init__(self, preorder):
        self.values: list = ["ROOT"]
        self.children: list[list[int]] = [[]]
        self.levels: list[list[int]] = [[0]]
        path = [0]
        for item in preorder if preorder is not None else []:
            depth, value = (item["depth"], item["value"]) if isinstance(item, dict) else (item[0], item[1])
            del path[int(depth) + 1:]
            node = len(self.values)
            self.values.append(value)
            self.children.append([])
            self.children[path[-1]].append(node)
            if len(path) == len(self.levels):
                self.levels.append([])
            self.levels[len(path)].append(node)
            path.append(node)
        self.sizes = [1] * len(self.values)
        for node in range(len(self.values) - 1, -1, -1):
            self.sizes[node] += sum(self.sizes[c] for c in self.children[node])


def tree_edit_distance(a: Tree, b: Tree) -> int:
    """Root relabel cost plus an alignment of the two child lists, from the deepest
    common level up.  Deleting or inserting a child costs its subtree size, but the
    first row/column of the alignment table counts children (not nodes) -- the
    scoring rule the reference uses, kept because its similarities depend on it."""
    below: dict[tuple[int, int], int] = {}
    for level in range(min(len(a.levels), len(b.levels)) - 1, -1, -1):
        here = {}
        for x in a.levels[level]:
            for y in b.levels[level]:
                kids_x, kids_y = a.children[x], b.children[y]
                row = list(range(len(kids_y) + 1))
                for i, p in enumerate(kids_x, 1):
                    last, row = row, [i] + [0] * len(kids_y)
                    for j, q in enumerate(kids_y, 1):
                        row[j] = min(last[j] + a.sizes[p], row[j - 1] + b.sizes[q], last[j - 1] + below[p, q])
                here[x, y] = row[-1] + (a.values[x] != b.values[y])
        below = here
    return below[0, 0]
