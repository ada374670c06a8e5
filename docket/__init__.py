"""docket: ordered, checked report deliverables from document corpora, as Spark DataFrame operators."""
