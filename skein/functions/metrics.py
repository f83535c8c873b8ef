"""Scores of answers and retrieval runs, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import ANSWER_STOP_WORDS, strings, word_set


def token_recall(prediction: Column, truth: Column) -> Column:
    """Share of the truth's telling words in the prediction; 0 without truth."""
    gt = word_set(truth)
    key = F.array_except(gt, strings(ANSWER_STOP_WORDS))
    key = F.when(F.size(key) > 0, key).otherwise(gt)
    return F.when(F.size(key) > 0, F.size(F.array_intersect(word_set(prediction), key)) / F.size(key)).otherwise(0.0)


def token_f1(prediction: Column, truth: Column) -> Column:
    """F1 of both word sets; 0 where either is empty or nothing is shared."""
    p, t = word_set(prediction), word_set(truth)
    both = F.size(F.array_intersect(p, t))
    return F.when((F.size(p) > 0) & (F.size(t) > 0) & (both > 0), 2.0 * both / (F.size(p) + F.size(t))).otherwise(0.0)


def answer_hit(prediction: Column, truth: Column, least: float = 0.6) -> Column:
    return token_recall(prediction, truth) >= least


def anchor_hit(context: Column, anchor: Column) -> Column:
    """A non-empty anchor is part of the context, ignoring case."""
    a = F.coalesce(anchor, F.lit(""))
    return (a != "") & F.contains(F.lower(F.coalesce(context, F.lit(""))), F.lower(a))


def composite(n: Column, answer_rate: Column, anchor_rate: Column, f1: Column, error_rate: Column) -> Column:
    """40 answer + 30 anchor + 20 F1 + 10 without errors, in percent points."""
    return F.round(40 * answer_rate + 30 * anchor_rate + 20 * f1 + 10 * (1 - error_rate), 2)


def run_score(source: Column, confidence: Column, hits: Column, chars: Column, mentions: Column) -> Column:
    """Score of one retrieval run, at most 100."""
    tier = F.when(source == "tier1+tier2", 3).when(source == "tier1", 2).when(source == "tier2", 1).otherwise(0)
    s = tier * 15 + confidence * 20 + F.least(hits, F.lit(5)) * 3 + F.least(chars / 100, F.lit(15.0)) + F.least(mentions, F.lit(5)) * 2
    return F.round(F.least(F.lit(100.0), s.cast("double")), 2)
