import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docket.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = session(
        "docket-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(shared),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


FILING = (
    "doc_id bigint, report_id bigint, original_filename string, original_path string, page_count int, category string, "
    "subcategory string, confidence double, reasoning string, sort_order int, status string, is_included boolean"
)


@pytest.fixture
def filings(spark):
    """Filings from partial rows: name and whatever differs from a plain ready document."""

    def make(*rows: dict):
        plain = dict(
            report_id=1, original_filename="a.pdf", original_path=None, page_count=1, category="APPENDIX_E", subcategory=None,
            confidence=None, reasoning=None, sort_order=0, status="ready", is_included=True,
        )
        full = [{**plain, "doc_id": i + 1, **r} for i, r in enumerate(rows)]
        columns = [c.strip().split()[0] for c in FILING.split(",")]
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in full], FILING)

    return make
