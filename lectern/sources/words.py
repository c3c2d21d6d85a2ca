"""Stop-word lists and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.values import PERIODS

# The analyst's own stop-words by purpose.
USER_STOPWORDS = {
    "base": (
        "감사 포스팅 댓글 블로그 방문 답방 이웃 서이추 소통 구경 안녕 오늘 하루 주말 행복 정성 공감 응원 부탁 글 얘기 이야기 말씀 선생 요즘 "
        "기사 기자 출처 뉴스 보도 사진 영상 화면 입력 수정 정보 자료 정리 분석 전문 대표 생각 사람 경우 정도 시간 부분 전체 내용 상황 문제 "
        "관련 이유 방법 결과 기준 수준 현실 이해 도움 가능 필요 중요 확인 진행 추가 포함 비교 예상 영향 변화 증가 감소 현재 지금 이제 이번 최근 "
        "올해 내년 작년 이후 일반 개인 본인 자체 사실 근거 표현 선택 결정 관심 걱정 계획 발표 과정 운영 관리 논의 추진 신청 반영 규모 비율 인원 공개 부분 전체 일부"
    ).split(),
    "topic": "의대 증원 의사 의료 정부 대학 정원 병원 환자 교육 정책 교수 전공의 보건 복지부 교육부 대통령 윤석열".split(),
    "admission": (
        "전형 수능 입시 수시 정시 모집 지원 학생 인재 학년도 학교 등급 합격 교과 학원 수학 과목 내신 종합 입학 학과 선발 서울대 학생부 "
        "논술 면접 학년 수험 성적 진학 전공 계열 대입 평가 시험 공부 전략 준비"
    ).split(),
    "geo": "서울 지역 지방 수도 전국 한국 대한민국 국민 국가 나라 사회 세계 미국 일본".split(),
}


def user_stopwords(spark: SparkSession, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """(category, keyword) of the analyst's lists, each keyword once in a category."""
    rows = [(k, w) for k, ws in (lists or USER_STOPWORDS).items() for w in dict.fromkeys(ws)]
    return spark.createDataFrame(rows, "category string, keyword string")


def read_stopwords(spark: SparkSession, path: str, comments: str = "keep") -> DataFrame:
    """(keyword) of the non-blank lines of a word list, stripped, each once. comments: keep or drop lines that begin with #."""
    lines = spark.read.text(path).select(strip(F.regexp_replace("value", "^\ufeff", "")).alias("keyword")).where("keyword <> ''")
    if comments == "drop":
        lines = lines.where(~F.col("keyword").startswith("#"))
    elif comments != "keep":
        raise ValueError("comments: keep or drop")
    return lines.distinct()


def read_stopwords_raw(spark: SparkSession, path: str) -> DataFrame:
    """(keyword) of all lines as they are, each once; a blank line is the empty word."""
    return spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("keyword")).distinct()


def layered_stopwords(spark: SparkSession, common: list[str], local: dict[int, str], comments: str = "drop") -> DataFrame:
    """(section, keyword) of general lists (section null: everywhere) and of one list for each section."""
    out = None
    for section, path in [*((None, p) for p in common), *sorted(local.items())]:
        part = read_stopwords(spark, path, comments).select(F.lit(section).cast("int").alias("section"), "keyword")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def calendar(spark: SparkSession, periods=PERIODS, most: int | None = None) -> DataFrame:
    """(section, date as yyyyMMdd) of every day of the periods, in order; the first `most` of them."""
    rows = spark.createDataFrame([(n, name, a, b) for n, name, a, b in periods], "number int, section string, first string, last string")
    days = rows.select("number", "section", F.explode(F.sequence(F.col("first").cast("date"), F.col("last").cast("date"))).alias("day"))
    days = days.orderBy("number", "day")
    days = days.limit(most) if most is not None else days
    return days.select("section", F.date_format("day", "yyyyMMdd").alias("date"))
