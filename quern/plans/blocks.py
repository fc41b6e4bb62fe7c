"""Feature blocks: fit() learns small state from training rows, transform() is a lazy plan over any rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import encode, lookups, spatial
from quern.sources.files import settled


class Block:
    """Base of all blocks. `needs` are columns that must be there; `makes` are those it adds or changes."""

    needs: Sequence[str] = ()
    makes: Sequence[str] = ()

    def fit(self, df: DataFrame) -> Block:
        return self

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        raise NotImplementedError

    def name(self) -> str:
        return S.snake_case(type(self).__name__)

    def describe(self) -> dict:
        return {"name": self.name(), "needs": list(self.needs), "makes": list(self.makes)}

    def check(self, df: DataFrame) -> None:
        if absent := [c for c in self.needs if c not in df.columns]:
            raise KeyError(f"{self.name()} needs {absent}")


class ValuesToNull(Block):
    """Values that mean nothing become missing; columns that aren't there are passed over."""

    def __init__(self, rules: Mapping[str, Sequence]) -> None:
        self.rules, self.makes = dict(rules), list(rules)

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return df.withColumns({c: S.values_to_null(F.col(c), v) for c, v in self.rules.items() if c in df.columns})


class CleanCategories(Block):
    def __init__(self, columns: Sequence[str], token: str = "__NA__") -> None:
        self.makes, self.token = list(columns), token

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return df.withColumns({c: S.filled(F.col(c), self.token) for c in self.makes if c in df.columns})


class KeepOrOthers(Block):
    def __init__(self, source: str, to: str, keep: Sequence[str], other: str = "OTHERS") -> None:
        self.needs, self.makes, self.keep, self.other = [source], [to], list(keep), other

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return df.withColumn(self.makes[0], S.keep_or(F.col(self.needs[0]), self.keep, self.other))


class Districts(Block):
    """District and neighbourhood from an address: by pattern, or by the second and third token."""

    def __init__(self, source: str, to: tuple[str, str], suffixes: tuple[str, str] = ("구", "동"), mode: str = "pattern") -> None:
        self.needs, self.makes, self.suffixes, self.mode = [source], list(to), suffixes, mode

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        c = F.col(self.needs[0])
        if self.mode == "token":
            found = [S.token(c, 1), S.token(c, 2)]
        else:
            found = [S.first_match(c.cast("string"), rf"(\S+{s})") for s in self.suffixes]
        return df.withColumns(dict(zip(self.makes, found)))


class RoadParts(Block):
    def __init__(self, source: str, to: tuple[str, str, str]) -> None:
        self.needs, self.makes = [source], list(to)

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return df.withColumns(dict(zip(self.makes, S.split_once(F.col(self.needs[0])))))


class JoinedRoad(Block):
    """The whole road name from its two parts."""

    def __init__(self, parts: tuple[str, str], to: str) -> None:
        self.needs, self.makes = list(parts), [to]

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return df.withColumn(self.makes[0], S.joined_key(*[F.col(c) for c in self.needs]))


class FillCoordinates(Block):
    """Missing coordinates from references: complexes by key, addresses by key, then the best fuzzy match of a complex."""

    def __init__(self, complexes: DataFrame, addresses: DataFrame, gu: str, dong: str, road: tuple[str, str, str], yx: tuple[str, str], complex_columns: Mapping[str, str], address_key: str, row_no: str = "row_no") -> None:
        self.needs, self.makes = [gu, dong, *road, *yx], list(yx)
        self.complexes, self.addresses = complexes, addresses
        self.gu, self.dong, self.road, self.of, self.key, self.row_no = gu, dong, road, complex_columns, address_key, row_no

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        y, x = self.makes
        full, main, sub = self.road
        of = self.of
        named = self.complexes.select(
            F.col(of["gu"]).alias(self.gu), F.col(of["dong"]).alias(self.dong), F.col(of["road_main"]).alias(main),
            F.col(of["road_sub"]).alias(sub), F.col(of["y"]).cast("double").alias(y), F.col(of["x"]).cast("double").alias(x), self.row_no,
        )
        named = named.withColumn("fill key", S.joined_key(F.col(self.gu), S.joined_key(F.col(main), F.col(sub))))
        addresses = self.addresses.select(F.col(self.key).alias("fill key"), F.col(y).cast("double").alias(y), F.col(x).cast("double").alias(x), self.row_no)
        rows = df.withColumn("fill key", S.joined_key(F.col(self.gu), F.col(full)))
        refs = [(lookups.last_wins(r, "fill key", (y, x), self.row_no), "fill key") for r in (named, addresses)]
        rows = lookups.cascade(rows, refs, (y, x)).drop("fill key")
        known = named.dropna(subset=[y, x])
        return lookups.fill_by_best_match(rows, known, (self.gu, self.dong, main), sub, (y, x), self.row_no)


class Transport(Block):
    """Distance to the nearest place and score of places near by, for several sets of places (y, x, name, part).

    A name weighs the power 0.7 of the number of its distinct parts (lines, stop numbers).
    """

    def __init__(self, places: Mapping[str, tuple[DataFrame, float]], yx: tuple[str, str], to: Mapping[str, tuple[str, str]], row: str = "_org_idx", lat0: float | None = None) -> None:
        self.needs, self.makes = [*yx, row], [c for pair in to.values() for c in pair]
        self.places, self.to, self.row, self.lat0 = places, to, row, lat0

    @staticmethod
    def weighted(places: DataFrame) -> DataFrame:
        weights = places.groupBy("name").agg(S.power_weight(F.count_distinct("part")).alias("weight"))
        return places.join(weights, "name").select(F.xxhash64("name", "part", "y", "x").alias("key"), "name", "y", "x", "weight")

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        y, x = self.needs[:2]
        df = settled(df)  # each set of places reads the rows again
        points = df.select(F.col(self.row).alias("id"), F.col(y).alias("y"), F.col(x).alias("x"))
        lat0 = self.lat0 if self.lat0 is not None else spatial.mean_latitude(points, "y")
        for kind, (places, radius) in self.places.items():
            near, score = self.to[kind]
            ready = settled(self.weighted(places))
            km = spatial.nearest_distance(points, ready.select("key", "y", "x").distinct(), lat0).select(F.col("id").alias(self.row), F.col("km").alias(near))
            sums = spatial.radius_score(points, ready, radius, lat0).select(F.col("id").alias(self.row), F.col("score").alias(score))
            df = df.join(km, self.row, "left").join(sums, self.row, "left")
        return df


class ContractDate(Block):
    def __init__(self, source: str, to: tuple[str, str, str]) -> None:
        self.needs, self.makes = [source], list(to)

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return df.withColumns(dict(zip(self.makes, S.year_month_quarter(F.col(self.needs[0])))))


class BuildYear(Block):
    """Age at the contract and years from contract to building, none below 0."""

    def __init__(self, built: str, contract: str, to: tuple[str, str]) -> None:
        self.needs, self.makes = [built, contract], list(to)

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        built, contract = (S.checked(F.col(c), 4).cast("int") for c in self.needs)
        return df.withColumns({self.makes[0]: S.positive_gap(contract, built), self.makes[1]: S.positive_gap(built, contract)})


class Membership(Block):
    def __init__(self, source: str, to: str, members: Sequence[str]) -> None:
        self.needs, self.makes, self.members = [source], [to], list(members)

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return df.withColumn(self.makes[0], S.flag(F.col(self.needs[0]).isin(self.members)))


class AreaShare(Block):
    """Share of a complex's units in the row's own size class, and whether all counts are missing."""

    def __init__(self, area: str, counts: Sequence[str], bounds: Sequence[float], to: tuple[str, str]) -> None:
        self.needs, self.makes, self.counts, self.bounds = [area], list(to), list(counts), list(bounds)

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        known = [S.to_number(F.col(c)) if c in df.columns else F.lit(None).cast("double") for c in self.counts]
        total, own = S.sum_of_known(known), S.by_range(S.to_number(F.col(self.needs[0])), list(zip(self.bounds, known)), known[-1])
        return df.withColumns({self.makes[0]: S.ratio(own, total), self.makes[1]: total.isNull().cast("int")})


class Ratios(Block):
    """Columns that are one column over another, where that is above 0."""

    def __init__(self, ratios: Mapping[str, tuple[str, str]]) -> None:
        self.ratios, self.makes = dict(ratios), list(ratios)
        self.needs = sorted({c for pair in ratios.values() for c in pair})

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return df.withColumns({to: S.ratio(S.to_number(F.col(a)), S.to_number(F.col(b))) for to, (a, b) in self.ratios.items()})


class Frequencies(Block):
    """Share of training rows that have the row's value; 0.0 for values that training lacks."""

    def __init__(self, columns: Mapping[str, str], token: str = "__NA__", default: float = 0.0) -> None:
        self.columns, self.makes, self.token, self.default = dict(columns), list(columns.values()), token, default
        self.state: dict[str, DataFrame] = {}

    def fit(self, df: DataFrame) -> Block:
        self.state = {c: encode.frequencies(df, c, self.token) for c in self.columns if c in df.columns}
        return self

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        for c, state in self.state.items():
            df = encode.apply_map(df, state, S.filled(F.col(c), self.token), self.columns[c], self.default)
        return df


class FixedCategories(Block):
    """Only the categories of training stay."""

    def __init__(self, columns: Sequence[str]) -> None:
        self.makes = list(columns)
        self.state: dict[str, DataFrame] = {}

    def fit(self, df: DataFrame) -> Block:
        self.state = {c: df.select(F.col(c).alias("value")).dropna().distinct() for c in self.makes if c in df.columns}
        return self

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        for c, state in self.state.items():
            df = encode.fixed_categories(df, state, c)
        return df


class Pipeline:
    """Blocks in order: each is fitted on what those before it made of the training rows."""

    def __init__(self, blocks: Sequence[Block]) -> None:
        self.blocks = list(blocks)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        for block in self.blocks:
            block.check(df)
            df = block.fit(df).transform(df, is_train=True)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for block in self.blocks:
            block.check(df)
            df = block.transform(df)
        return df

    def summarize(self) -> list[dict]:
        return [b.describe() for b in self.blocks]
