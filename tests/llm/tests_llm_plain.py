"""Brute-force versions that several tests share."""

from test_line_dedup import plain
from test_near_dedup import brute


def line_dedup_brute(docs, least):
    return {i: text for i, (text, _, _) in plain(docs, least).items()}


def near_dedup_brute(docs):
    return {i for i, (_, component) in brute(docs).items() if component == i}
