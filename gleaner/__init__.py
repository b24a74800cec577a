"""Record curation on Spark: near-duplicate resolution, date repair, scoring, review folds,
story order, pagination, layout and audits, all as DataFrame jobs."""
