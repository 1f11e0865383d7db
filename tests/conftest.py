import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lexiline import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", 4)
    yield s
    s.stop()


WORDS = "track_id long, pos long, word_id long, word string, start_ms long, end_ms long, confidence double, is_profanity boolean, detection_source string, censor_type string"


@pytest.fixture
def words(spark):
    """Build a timeline from (word, start_ms, end_ms[, flag[, source[, type]]]) tuples."""

    def build(*rows, track=1):
        out = []
        for i, r in enumerate(rows):
            w, s, e, flag, source, kind = (*r, *(False, None, None)[len(r) - 3 :])
            out.append((track, i, i, w, s, e, 0.9, flag, source, kind))
        return spark.createDataFrame(out, WORDS)

    return build
