"""Awkward documents."""

import random


def cases(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Documents with nulls, empty and long texts, ties, repeats, shared passages, odd white space and scripts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    line = "This line is in many documents " + word()
    base = [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(25)]
    out: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    out += [(30 + i, f"{base[i]} {passage} {base[i + 1]}") for i in range(8)]
    out += [(40 + i, f"{base[i]}\n  {line.upper()}\t\n{line}\n{base[i + 2]}\n") for i in range(6)]
    out += [(50 + i, base[3]) for i in range(4)] + [(60 + i, base[9] + f" x{i}") for i in range(12)]
    out += [(70, " ".join(word() for _ in range(4000))), (71, passage * 3), (72, "ab " * 300), (73, "a"), (74, " \t\n "), (75, "\n"), (76, "日本語 テキスト 🙂 " * 9), (77, "x\r\ny\x0b z")]
    out += [(80, None), (81, ""), (82, ""), (None, base[4]), (None, None), (83, base[5]), (83, base[5]), (83, base[6] + "!"), (0, base[0])]
    rng.shuffle(out)
    return out
