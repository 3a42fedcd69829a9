"""Texts for the tests."""

import random


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "or", "an", "ing", "st", "é", "ß", "on"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def edge_texts() -> list:
    """Null, empty, blank, tiny, repeated and long texts, near copies, odd white space and symbols."""
    base = words(1, 150)
    near = base.split(" ")
    near[70] = "changed"
    long = words(2, 6000)
    return [
        None, "", "   ", "a", "one two", base, base, " ".join(near), base.upper(), words(3, 40) + "\n" + base,
        long, "x" * 700, words(4, 30) + "  double  spaces \n \t mixed", "<|endoftext|> in a text", "日本語 テキスト 123", "tail ",
        words(5, 60) + " 4111 1111 1111 1111 and +1 (415) 555-2671, a.b@c.example.org 10.0.0.1",
        base[:400] + long[:900] + base[:400],
    ]
