"""Table jobs: ordered fills, joins and matching, aggregation, notes, links, graphs, versions and evidence."""
