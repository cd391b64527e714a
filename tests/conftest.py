import os
import re
import sys
from dataclasses import dataclass
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
sys.path.insert(0, str(REPO / "tests"))

from tidegraph.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        2,
        {
            "spark.default.parallelism": "2",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.streaming.metricsEnabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@dataclass(frozen=True)
class Stored:
    """A stored input and the graph it must give, as listed in FIXTURES.md."""

    source: str
    expected: str
    n_commands: int
    n_vertices: int
    n_edges: int
    modes: str


def stored_fixtures() -> list[Stored]:
    """The exactly reproducible rows of the first table of FIXTURES.md."""
    text = (REPO / "FIXTURES.md").read_text()
    root = re.search(r"Paths under `([^`]+)`", text).group(1).rstrip("/")
    base = re.search(r"^`B = ([^`]+)`", text, re.M).group(1)
    number = lambda s: int(s.replace(",", ""))
    found = []
    for line in text.splitlines():
        cells = [c.strip() for c in line.strip("|").split("|")]
        if len(cells) == 7 and cells[6].startswith("exact"):
            source = cells[0].strip("`").replace("B/", f"{root}/{base}/", 1)
            found.append(
                Stored(
                    re.sub(r"/\{.*\}$", "", source),
                    f"{root}/{cells[3].strip('`')}",
                    number(cells[2]),
                    number(cells[4]),
                    number(cells[5]),
                    cells[6],
                )
            )
    return [f for f in found if os.path.exists(f.source)]
