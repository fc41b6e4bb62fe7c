"""The house-price feature plan: tables, names, blocks in their order, and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.plans import blocks as B
from quern.plans.builder import ID, DatasetBuilder
from quern.sources.files import Places, read_csv, stored

# Names of the input columns, features and members, as the data has them.
NAMES = {
    "전용면적(㎡)": "전용면적",
    "k-건설사(시공사)": "건설시공사",
    "k-단지분류(아파트,주상복합등등)": "단지분류",
    "k-세대타입(분양형태)": "세대분양형태",
    "k-관리방식": "관리방식",
    "k-복도유형": "복도유형",
    "k-난방방식": "난방방식",
    "k-전체동수": "전체동수",
    "k-전체세대수": "전체세대수",
    "k-시행사": "시행사",
    "k-연면적": "연면적",
    "k-주거전용면적": "주거전용면적",
    "k-관리비부과면적": "관리비부과면적",
    "k-전용면적별세대현황(60㎡이하)": "전용면적세대수_60",
    "k-전용면적별세대현황(60㎡~85㎡이하)": "전용면적세대수_60_85",
    "k-85㎡~135㎡이하": "전용면적세대수_85_135",
    "k-135㎡초과": "전용면적세대수_135",
    "기타/의무/임대/임의=1/2/3/4": "의무_임대_임의_기타",
}
NUMERIC = [
    "전용면적", "층", "건축년도", "좌표X", "좌표Y", "계약년", "계약월", "건물나이", "건축지연", "강남권여부", "계약분기", "지하철거리",
    "버스거리", "지하철500m내점수", "버스300m내점수", "단지면적비중", "단지면적정보결측", "전체동수", "전체세대수", "연면적", "주거전용면적",
    "관리비부과면적", "건축면적", "주차대수", "주차대수_세대당", "세대수_동수당", "연면적_전용면적비", "건설시공사_빈도", "시행사_빈도", "아파트명_빈도",
]
CATEGORICAL = ["구", "동", "복도유형", "난방방식", "관리방식", "세대전기계약방법", "청소비관리형태", "단지분류", "거래유형", "임대구분", "세대분양형태"]
INTEGERS = ["계약년", "계약월", "계약분기", "층", "건축년도"]
PREMIUM = ["강서구", "영등포구", "동작구", "서초구", "강남구", "송파구", "강동구"]
UNITS = ["전용면적세대수_60", "전용면적세대수_60_85", "전용면적세대수_85_135", "전용면적세대수_135"]
COMPLEX = {"gu": "주소(시군구)", "dong": "주소(읍면동)", "road_main": "주소(도로명)", "road_sub": "주소(도로상세주소)", "y": "좌표Y", "x": "좌표X"}


def pipeline(ext: dict[str, DataFrame], subway_km: float = 0.5, bus_km: float = 0.3, dong_mode: str = "pattern") -> B.Pipeline:
    subway = ext["subway"].select(F.col("역사명").alias("name"), F.col("호선").alias("part"), F.col("위도").cast("double").alias("y"), F.col("경도").cast("double").alias("x"))
    bus = ext["bus"].select(F.col("정류소명").alias("name"), F.col("정류소번호").cast("string").alias("part"), F.col("Y좌표").cast("double").alias("y"), F.col("X좌표").cast("double").alias("x"))
    road = ("도로명_전체", "도로명_앞", "도로명_뒤")
    return B.Pipeline([
        B.ValuesToNull({"거래유형": ["-"]}),
        B.CleanCategories([c for c in CATEGORICAL if c not in ("구", "동", "임대구분")]),
        B.KeepOrOthers("의무_임대_임의_기타", "임대구분", ["의무", "임대", "임의"]),
        B.Districts("시군구", ("구", "동"), mode=dong_mode),
        B.RoadParts("도로명", road),
        B.FillCoordinates(ext["apt"], ext["coord"], "구", "동", road, ("좌표Y", "좌표X"), COMPLEX, "매핑키"),
        B.Transport({"subway": (subway, subway_km), "bus": (bus, bus_km)}, ("좌표Y", "좌표X"), {"subway": ("지하철거리", "지하철500m내점수"), "bus": ("버스거리", "버스300m내점수")}),
        B.ContractDate("계약년월", ("계약년", "계약월", "계약분기")),
        B.BuildYear("건축년도", "계약년", ("건물나이", "건축지연")),
        B.Membership("구", "강남권여부", PREMIUM),
        B.AreaShare("전용면적", UNITS, (60, 85, 135), ("단지면적비중", "단지면적정보결측")),
        B.Ratios({"주차대수_세대당": ("주차대수", "전체세대수"), "세대수_동수당": ("전체세대수", "전체동수"), "연면적_전용면적비": ("연면적", "주거전용면적")}),
        B.Frequencies({"건설시공사": "건설시공사_빈도", "시행사": "시행사_빈도", "아파트명": "아파트명_빈도"}),
    ])


def builder(spark: SparkSession, places: Places, target_transform: str = "log1p") -> DatasetBuilder:
    """Tables as CSV under the places' raw and ext folders; row order is the file's."""

    def numbered(df: DataFrame, to: str) -> DataFrame:
        # file order: one small window over a row's offset in its file, for reference tables alone
        return df.withColumn("at", F.monotonically_increasing_id()).withColumn(to, F.row_number().over(W.orderBy("at"))).drop("at")

    def load() -> tuple[DataFrame, DataFrame]:
        # numbers must not change when a task is run again: they are written with the rows once
        return tuple(stored(read_csv(spark, f"{places.raw}/{n}.csv").withColumn(ID, F.monotonically_increasing_id()), places, n) for n in ("train", "test"))

    def ext() -> dict[str, DataFrame]:
        files = {"apt": "k-apt", "coord": "coord", "subway": "subway_feature", "bus": "bus_feature"}
        return {k: numbered(read_csv(spark, f"{places.ext}/{f}.csv"), "row_no") for k, f in files.items()}

    return DatasetBuilder(load, ext, pipeline, NAMES, NUMERIC + CATEGORICAL, CATEGORICAL, INTEGERS, "target", target_transform)
