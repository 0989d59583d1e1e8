"""What a model is told: one wording for the batch of messages and for single calls."""

from __future__ import annotations

SYSTEM = "Answer from the numbered blocks alone, in three sentences at most, and cite the blocks. State no opinion and no performance figure."
#: Characters of evidence that a prompt holds, headers and gaps included.
BUDGET = 6000


def block(number: int, source: str, text: str) -> str:
    return f"[S{number}] {source}\n{text}"


def turns(question: str, candidates: list, budget: int = BUDGET) -> list[dict]:
    """Both turns, with numbered blocks while they fit the budget, up to the first that doesn't."""
    blocks, used = [], -2
    for i, c in enumerate(candidates, 1):
        one = block(i, c.get("source_url") or "", c["text"])
        used += len(one) + 2
        if used > budget:
            break
        blocks.append(one)
    context = "\n\n".join(blocks)
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"{context}\n\nQuestion: {question}"}]
