import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

WORDS = "river stone lamp winter garden paper window silver music bread travel engine harbour quiet orange letter market forest cloud bridge candle spring hunter marble".split()


def prose(seed: int, n: int) -> str:
    """n words by a seeded draw, a line break after each 12."""
    draw = random.Random(seed)
    words = [draw.choice(WORDS) + draw.choice(["", "s", "ed", "ly", str(seed % 7)]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def changed(text: str, at: int, to: str) -> str:
    return text[:at] + to + text[at + 1 :]


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str | None]]:
    """Texts with copies, near copies, ties, null, empty and very long ones."""
    base = [(i, prose(i, 30 + 7 * i)) for i in range(20)]
    copies = [(20 + i, base[i][1]) for i in range(5)]
    near = [(30 + i, changed(base[10 + i][1], 40, "#")) for i in range(5)]
    odd = [(40, None), (41, ""), (42, " \n\t"), (43, "one"), (44, "One"), (45, "Ünïcode — 漢字 𝒳 text\nÜnïcode — 漢字 𝒳 text"), (46, prose(99, 20_000)), (47, "x" * 50_000)]
    return base + copies + near + odd
