"""The cutters of docloom.operators.chunking one text at a time, as tests compare them."""

import re

from docloom.operators.chunking import LIMITS, is_table, packed, sentences


def fallback(text: str, most: int = LIMITS.fallback, carry: int = LIMITS.overlap_sentences) -> list[str]:
    """Sentences packed up to `most` characters; a chunk opens with the last `carry`
    sentences of the one before."""
    clean = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    return [" ".join(g) for g in packed(sentences(clean), most, carry=carry)]


def base_blocks(text: str, limits=LIMITS) -> list[str]:
    """Blocks of about limits.block characters; a table is one, a long sentence is cut."""
    if not text.strip():
        return []
    if is_table(text):
        return [text.strip()]
    found, run = [], []

    def close() -> None:
        found.extend(" ".join(g) for g in packed(run, limits.block))
        run.clear()

    for s in sentences(text) or [text]:
        if len(s) > limits.hard_block:
            close()
            found.extend(p for at in range(0, len(s), limits.block) if (p := s[at : at + limits.block].strip()))
        else:
            run.append(s)
    close()
    return found


def mixed_tokens(text: str) -> int:
    """The estimate of docloom.functions.text.token_estimate, of one text."""
    other = len(re.findall(r"[^\x00-\x7F]", text))
    plain, blank = len(re.findall(r"[0-9A-Za-z]", text)), len(re.findall(r"[\x09-\x0D\x1C-\x20]", text))
    part = other / 1.5 + plain / 4 + (len(text) - other - plain - blank) / 2 + blank / 5
    return max(1, int(part + max(1.0, part * 0.05)))


def merge_blocks(blocks: list[str], starts: list[bool], limits=LIMITS, overlap: int = 1, least_tokens: int = 70, most_tokens: int = 800) -> list[tuple[str, bool]]:
    """Chunks of blocks, a new one at each start, and whether text was lost to the limit.
    Each opens with the last `overlap` blocks of the one before (one at least), is cut at
    limits.child, and a small one joins its predecessor if both stay within most_tokens."""
    groups: list[list[str]] = []
    for block, start in zip(blocks, starts, strict=True):
        if start or not groups:
            groups.append([])
        groups[-1].append(block)
    out: list[tuple[str, bool]] = []
    for i, g in enumerate(groups):
        whole = " ".join((groups[i - 1][-max(1, overlap) :] if i else []) + g).strip()
        text, lost = whole[: limits.child], len(whole) > limits.child
        if out and mixed_tokens(text) < least_tokens and mixed_tokens(out[-1][0]) + mixed_tokens(text) <= most_tokens:
            out[-1] = (out[-1][0] + " " + text, out[-1][1] or lost)
        else:
            out.append((text, lost))
    return out


def paragraphs(text: str, least: int = 50) -> list[str]:
    """Paragraphs by empty lines; one shorter than `least` absorbs the next."""
    out: list[str] = []
    for p in (p for p in re.split(r"\n(?:[^\S\n]*\n)+", text) if p.strip()):
        if out and len(out[-1]) < least:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def pack_lines(text: str, most: int = 20_000) -> list[str]:
    return ["\n".join(g) for g in packed(text.split("\n"), most)]
