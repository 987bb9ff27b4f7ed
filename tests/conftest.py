import datetime as dt

import pytest

from paneloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4, spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def day():
    return lambda s: dt.date.fromisoformat(s)


@pytest.fixture
def rows():
    """Rows as sorted tuples, floats rounded."""
    def get(df, *cols, nd=9):
        cols = cols or df.columns
        fix = lambda v: round(v, nd) if isinstance(v, float) else v
        return sorted((tuple(fix(r[c]) for c in cols) for r in df.collect()), key=lambda t: [str(v) for v in t])
    return get
