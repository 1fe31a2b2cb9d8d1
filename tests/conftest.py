import pytest

from tallymark import session


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""

    def collect(df, *names):
        picked = df.select(*[f"`{n}`" for n in names]) if names else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
