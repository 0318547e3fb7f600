"""Chat text, completion-only masks and token truncation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspool.fixed_values import (
    IGNORED_LABEL,
    MATH_SYSTEM_PROMPT,
    MAX_TOKENS,
    RESPONSE_TEMPLATE,
    TURN_CLOSING,
    TURN_OPENING,
)
from larkspool.functions.binding import let


@dataclass(frozen=True)
class ChatTemplate:
    """Markup around a chat turn: opening, role, newline, content, closing."""

    opening: str = TURN_OPENING
    closing: str = TURN_CLOSING

    def turn(self, role: str, content: Column) -> Column:
        return F.concat(
            F.lit(f"{self.opening}{role}\n"), F.coalesce(content, F.lit("")), F.lit(self.closing)
        )

    def opened(self, role: str) -> Column:
        return F.lit(f"{self.opening}{role}\n")


def chat_text(
    instruction: Column,
    output: Column,
    system_prompt: str = MATH_SYSTEM_PROMPT,
    template: ChatTemplate = ChatTemplate(),
) -> Column:
    """Training text: system, user and assistant turn."""
    return F.concat(
        template.turn("system", F.lit(system_prompt)),
        template.turn("user", instruction),
        template.turn("assistant", output),
    )


def chat_prompt(
    instruction: Column,
    system_prompt: str = MATH_SYSTEM_PROMPT,
    template: ChatTemplate = ChatTemplate(),
) -> Column:
    """Evaluation prompt: system and user turn, then an opened assistant turn."""
    return F.concat(
        template.turn("system", F.lit(system_prompt)),
        template.turn("user", instruction),
        template.opened("assistant"),
    )


def truncate_tokens(tokens: Column, limit: int = MAX_TOKENS) -> Column:
    """The first ``limit`` tokens."""
    return F.slice(tokens, 1, limit)


def mask_prompt(tokens: Column, template: list[int]) -> Column:
    """Labels for a completion-only loss.

    Everything up to and including the first occurrence of ``template`` becomes
    the ignored label; without an occurrence the tokens are returned unchanged.
    The occurrence is found by one substring search over the comma-separated
    tokens, which is linear and stops at the first hit.
    """
    wanted = F.lit("," + "".join(f"{t}," for t in template))

    def labels(listed: Column) -> Column:
        # Tokens before the hit = commas before the hit.
        before = F.substr(listed, F.lit(1), F.position(wanted, listed) - 1)
        commas = F.length(before) - F.length(F.replace(before, F.lit(","), F.lit("")))
        return let(commas + len(template), masked)

    def masked(count: Column) -> Column:
        ignored = F.array_repeat(F.lit(IGNORED_LABEL), count)
        return F.concat(ignored, F.slice(tokens, count + 1, F.size(tokens)))

    listed = F.concat(F.lit(","), F.array_join(tokens, ",", ""), F.lit(","))
    return let(listed, lambda text: F.when(F.contains(text, wanted), labels(text)).otherwise(tokens))


def completion_text(text: Column, template: str = RESPONSE_TEMPLATE) -> Column:
    """Text form of the mask: what follows the first response template; all of it if there is none."""
    hit = F.position(F.lit(template), text)
    return F.when(hit > 0, F.substr(text, hit + len(template))).otherwise(text)
