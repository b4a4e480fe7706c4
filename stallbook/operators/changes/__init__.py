"""Batches of change requests applied to state frames.

Each operator takes the current state and a `requests` frame (one row per call:
`request_id`, usually `actor_id`, and the call's parameters) and returns a
`Change`: the new state frames and a `results` frame with one row per request.

`request_id` must be unique in a batch; its order is the order of the calls.
New ids come from it without a shuffle, see `base.new_ids`.
"""

from .base import Change

__all__ = ["Change"]
