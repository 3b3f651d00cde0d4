"""Column contracts and the fixed lookup values of the sales fact table."""

from __future__ import annotations

from pyspark.sql import types as T

REGIONS = ("NA_Sales", "EU_Sales", "JP_Sales", "Other_Sales")
SCORES = ("Site_Score", "Critic_Score", "User_Score")
DEDUP_KEY = ("Name", "Platform", "Year", "Publisher")
INGEST_ID = "ingest_id"

TEXT_COLUMNS = (
    "Name", "Platform", "Platform_Family", "Genre", "Publisher", "Developer",
    "Release_Date", "Last_Update",
)
NUMERIC_COLUMNS = ("Rank", *REGIONS, "Global_Sales", "Total_Shipped", *SCORES)

RAW_COLUMNS = (
    "Rank", "Name", "Platform", "Platform_Family", "Year", "Genre", "Publisher",
    "Developer", "NA_Sales", "EU_Sales", "JP_Sales", "Other_Sales", "Global_Sales",
    "Site_Score", "Critic_Score", "User_Score", "Total_Shipped", "Release_Date",
    "Last_Update",
)
CORRUPT_RECORD = "_corrupt_record"

# Every raw column is read as text; typed values come from try_cast later, so a bad
# cell becomes NULL instead of failing the job and no inferSchema pass is needed.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("Rank", T.LongType()),
        T.StructField("Name", T.StringType()),
        T.StructField("Platform", T.StringType()),
        T.StructField("Platform_Family", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Genre", T.StringType()),
        T.StructField("Publisher", T.StringType()),
        T.StructField("Developer", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in REGIONS],
        T.StructField("Global_Sales", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in SCORES],
        T.StructField("Total_Shipped", T.DoubleType()),
        T.StructField("Release_Date", T.DateType()),
        T.StructField("Last_Update", T.DateType()),
        T.StructField("Regional_Sales_Sum", T.DoubleType()),
        T.StructField("Is_Outlier", T.BooleanType()),
        T.StructField("Outlier_Score", T.DoubleType()),
        T.StructField("Top_Region", T.StringType()),
        T.StructField("Top_Region_CN", T.StringType()),
        *[T.StructField(f"{c}_Share", T.DoubleType()) for c in REGIONS],
        T.StructField("Platform_Family_CN", T.StringType()),
        T.StructField("Decade", T.IntegerType()),
        T.StructField("Age_Years", T.IntegerType()),
        T.StructField("Release_Quarter", T.StringType()),
        T.StructField("Composite_Score", T.DoubleType()),
        T.StructField("Score_Gap", T.DoubleType()),
        T.StructField("Is_Modern_Title", T.BooleanType()),
        T.StructField("Sales_Tier", T.StringType()),
        T.StructField("Score_Tier", T.StringType()),
        T.StructField("Has_Critic_Score", T.BooleanType()),
        T.StructField("Has_User_Score", T.BooleanType()),
        T.StructField("Canonical_Name", T.StringType()),
        T.StructField("PCA_Region_1", T.DoubleType()),
        T.StructField("PCA_Region_2", T.DoubleType()),
        T.StructField("Regional_Cluster", T.IntegerType()),
        T.StructField("Regional_Cluster_Label", T.StringType()),
    ]
)

# ---- Fixed values: they must equal the reference's for results to match. ----

UNKNOWN_GENRE = "其他"
UNKNOWN_FAMILY = "Other"
UNKNOWN_FAMILY_LABEL = "其他平台"
OTHER_PUBLISHER = "OtherPublisher"
CLUSTER_LABEL_SUFFIX = "主导"

# Tier name -> closed upper edge; the last tier is open. Bins are right-closed.
SALES_TIERS = (("<1M", 1.0), ("1-5M", 5.0), ("5-10M", 10.0), ("10-20M", 20.0), ("20M+", None))
SCORE_TIERS = (("<=6", 6.0), ("6_to_8", 8.0), (">=8", None))
AGE_BUCKETS = (("首发年", 1.0), ("1-3 年", 3.0), ("4-7 年", 7.0), ("7 年以上", None))

REGION_LABELS = {
    "NA_Sales": "北美销量",
    "EU_Sales": "欧洲销量",
    "JP_Sales": "日本销量",
    "Other_Sales": "其他地区销量",
}
GLOBAL_SALES_LABEL = "全球销量（百万套）"

FEATURE_LABELS = {
    "Platform_Family": "平台",
    "Genre": "类型",
    "Publisher_Grouped": "发行商",
    "Year": "年份",
    "Decade": "年代",
}

PLATFORM_FAMILIES = {
    "2600": "Atari", "3DO": "Panasonic", "3DS": "Nintendo", "5200": "Atari",
    "7800": "Atari", "ACPC": "Home Computer", "AJ": "Atari", "AST": "Atari",
    "Aco": "Atari", "All": "All", "Amig": "Home Computer", "And": "Mobile",
    "ApII": "Home Computer", "Arc": "Arcade", "BBCM": "Home Computer", "BRW": "PC",
    "C128": "Home Computer", "C64": "Home Computer", "CD32": "Home Computer",
    "CDi": "Other", "CV": "Other", "DC": "Sega", "DS": "Nintendo", "DSi": "Nintendo",
    "DSiW": "Nintendo", "FDS": "Nintendo", "FMT": "Home Computer", "GB": "Nintendo",
    "GBA": "Nintendo", "GBC": "Nintendo", "GC": "Nintendo", "GEN": "Sega", "GG": "Sega",
    "GIZ": "Other", "Int": "Other", "Linux": "PC", "Lynx": "Atari", "MS": "Sega",
    "MSD": "PC", "MSX": "Home Computer", "Mob": "Mobile", "N64": "Nintendo",
    "NES": "Nintendo", "NG": "SNK", "NGage": "Mobile", "NS": "Nintendo",
    "NS2": "Nintendo", "OR": "PC", "OSX": "PC", "Ouya": "Other", "PC": "PC",
    "PCE": "NEC", "PCFX": "NEC", "PS": "PlayStation", "PS2": "PlayStation",
    "PS3": "PlayStation", "PS4": "PlayStation", "PS5": "PlayStation",
    "PSN": "PlayStation", "PSP": "PlayStation", "PSV": "PlayStation", "S32X": "Sega",
    "SAT": "Sega", "SCD": "Sega", "SNES": "Nintendo", "Series": "Other", "TG16": "NEC",
    "VB": "Nintendo", "VC": "Nintendo", "WS": "Bandai", "WW": "Bandai",
    "Wii": "Nintendo", "WiiU": "Nintendo", "WinP": "Mobile", "X360": "Xbox",
    "XB": "Xbox", "XBL": "Xbox", "XOne": "Xbox", "XS": "Xbox", "ZXS": "Home Computer",
    "iOS": "Mobile", "iQue": "Nintendo",
}

FAMILY_LABELS = {
    "All": "全平台", "Arcade": "街机平台", "Atari": "雅达利平台", "Bandai": "万代平台",
    "Home Computer": "复古家用电脑", "Mobile": "移动 / 云游戏平台", "NEC": "NEC 平台",
    "Nintendo": "任天堂家族", "Other": "其他平台", "PC": "个人计算机",
    "Panasonic": "松下平台", "PlayStation": "PlayStation 家族", "SNK": "SNK 平台",
    "Sega": "世嘉平台", "Xbox": "Xbox 家族",
}

GENRE_LABELS = {
    "Action": "动作", "Action-Adventure": "动作冒险", "Adventure": "冒险",
    "Board Game": "桌游", "Education": "教育", "Fighting": "格斗", "MMO": "大型多人",
    "Misc": "其他", "Music": "音乐节奏", "Party": "派对", "Platform": "平台跳跃",
    "Puzzle": "益智", "Racing": "竞速", "Role-Playing": "角色扮演", "Sandbox": "沙盒",
    "Shooter": "射击", "Simulation": "模拟", "Sports": "体育", "Strategy": "策略",
    "Visual Novel": "视觉小说",
}

# ---- End of fixed values. ----
