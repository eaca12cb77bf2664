"""Ordered forests as balanced parentheses, with range min-max blocks of the excess."""

from __future__ import annotations

import numpy as np

BLOCK = 256  # parentheses of one block
CHUNK = 4096  # queries answered together
FAR = np.iinfo(np.int64).max


class Parentheses:
    """A forest given by the depths of its nodes in preorder (roots have the depth of the first node).

    A node opens when it is reached and closes when its subtree is done. The excess after a place is the number of
    opened nodes that are still open. Blocks keep their smallest and largest excess, a binary tree over the blocks those
    of larger ranges; as the excess changes by one from place to place, a range holds a value between the two.
    """

    def __init__(self, depths: np.ndarray):
        n = len(depths)
        self.opens = 2 * np.arange(n) + depths[:1].sum() - depths  # as many closings lie before a node as nodes, less the climb
        steps = np.full(2 * n, -1, np.int64)
        steps[self.opens] = 1
        excess = np.cumsum(steps)
        width = max(1, -(-2 * n // BLOCK))
        self.blocks = np.full(width * BLOCK, FAR)
        self.blocks[:2 * n] = excess
        self.blocks = self.blocks.reshape(width, BLOCK)
        low = self.blocks.min(axis=1)
        high = np.where(self.blocks == FAR, -1, self.blocks).max(axis=1)
        self.levels = [(low, high)]
        while len(low) > 1:
            if len(low) % 2:
                low, high = np.append(low, FAR), np.append(high, -1)
                self.levels[-1] = (low, high)
            low, high = low.reshape(-1, 2).min(axis=1), high.reshape(-1, 2).max(axis=1)
            self.levels.append((low, high))

    def findclose(self, nodes: np.ndarray | None = None) -> np.ndarray:
        """Place of the parenthesis that closes each of the nodes (numbers in preorder; all without argument)."""
        at = self.opens if nodes is None else self.opens[nodes]
        return np.concatenate([self._close(at[a:a + CHUNK]) for a in range(0, len(at), CHUNK)] or [at])

    def _close(self, at: np.ndarray) -> np.ndarray:
        block, offset = np.divmod(at, BLOCK)
        target = self.blocks[block, offset] - 1  # the excess behind the closing place, met there first
        out, here = self._first(block, offset + 1, target)
        rest = np.flatnonzero(~here)
        if rest.size:
            block, target = self._next_block(block[rest] + 1, target[rest]), target[rest]
            out[rest] = self._first(block, np.zeros(len(block), np.int64), target)[0]
        return out

    def _first(self, block: np.ndarray, start: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place from ``start`` on in the block with the excess ``target``, and if there is one."""
        fits = (self.blocks[block] == target[:, None]) & (np.arange(BLOCK) >= start[:, None])
        return block * BLOCK + fits.argmax(axis=1), fits.any(axis=1)

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First block from ``block`` on whose range holds ``target``; there is one."""
        found, height = np.full(len(block), -1), np.zeros(len(block), np.int64)
        place = block.copy()
        for number, (low, high) in enumerate(self.levels):
            # a right child, or the top, is looked at itself; a left child is covered by its parent
            look = np.flatnonzero((found < 0) & ((place % 2 == 1) | (number == len(self.levels) - 1)))
            fits = look[(low[place[look]] <= target[look]) & (high[place[look]] >= target[look])]
            found[fits], height[fits] = place[fits], number
            place = (place + 1) // 2
        for number in range(len(self.levels) - 1, 0, -1):
            low, high = self.levels[number - 1]
            down = np.flatnonzero(height == number)
            left = 2 * found[down]
            fits = (low[left] <= target[down]) & (high[left] >= target[down])
            found[down], height[down] = np.where(fits, left, left + 1), number - 1
        return found
