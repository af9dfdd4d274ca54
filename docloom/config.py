"""Run settings, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Decision limits of the extraction contract.
    match_threshold: float = 0.75
    near_miss_min_score: float = 0.3
    validation_fallback_threshold: int = 2
    supplier_weight: float = 0.1
    family_ratio: float = 70.0
    target_keywords: int = 5
    min_token_len: int = 5
    prompt_max_chars: int = 6000
    chat_max_chars: int = 8000

    # How much of the template dimension may travel inside the plan. Both are checked against the
    # store itself before matching; a larger store takes the join-based path.
    inline_max_templates: int = 2_000
    inline_max_keywords: int = 10_000
    inline_max_bytes: int = 8 * 1024 * 1024

    # Below these, matching spells the store out as ordinary column expressions, which Spark compiles
    # into the stage (measured twice as fast); above them it is data for higher-order functions.
    compiled_max_templates: int = 64
    compiled_max_keywords: int = 512
    # What one keyword automaton may hold: each text is read once per such piece of a large store. A character
    # takes about 40 bytes of every Python worker.
    automaton_max_templates: int = 50_000
    automaton_max_chars: int = 2_000_000
    # What one packed piece may hold, if a store of several automata is asked for decisions alone. A template takes
    # about 50 bytes and 4 a keyword, a distinct word 12 and its own bytes, of every Python worker.
    packed_max_templates: int = 400_000
    packed_max_chars: int = 20_000_000
    # Rules and checks whose patterns become literals of the plan, compiled once per task.
    compiled_max_rules: int = 128
