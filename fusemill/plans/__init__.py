"""The registered queries; importing this package fills the registry."""

from fusemill.plans import automaton_queries, graph_queries, interval_queries, loader_queries, ranking_queries, record_queries, reject_queries, relational_queries, router_queries, run_queries, sketch_queries, store_queries, stream_queries, structure_queries, support_queries, text_queries  # noqa: F401
