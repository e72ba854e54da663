"""What tests of the engine compare."""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, 0 if v is None else v) for v in r))
