"""Registered queries; importing this package registers them."""

from . import condition_queries, edge_queries, event_queries, filing_queries, frame_queries, intraday_queries, more_queries, panel_queries, path_queries, screen_queries, state_queries, stream_queries, text_queries, transition_queries  # noqa: F401
