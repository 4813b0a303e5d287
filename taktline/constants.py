"""They have to equal the published data conventions."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

# Prefecture names by number, 1 to 47.
PREFECTURES = [
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県",
    "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県", "新潟県", "富山県",
    "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県",
    "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県",
    "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県", "福岡県",
    "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
]
PREFECTURE_NATIONWIDE_CODE = 99
PREFECTURE_NATIONWIDE = "全国"
PREFECTURE_UNKNOWN = "不明"
PREFECTURE_UNKNOWN_BUCKET = "全国・都道府県不明"

# Legal forms removed from operator names.
LEGAL_FORMS = [
    "一般社団法人", "公益社団法人", "公益財団法人", "一般財団法人",
    "特定非営利活動法人", "社会福祉法人", "合同会社", "合資会社", "合名会社",
    "株式会社", "有限会社", "（株）", "(株)", "㈱", "（有）", "(有)", "㈲",
    "（一社）", "(一社)", "（公社）", "(公社)", "（公財）", "(公財)",
]

# Logical field -> header terms of the operator-statistics files.
FIELD_TERMS = {
    "operator_name": ("事業者名", "事業者", "会社名"),
    "operator_number": ("事業者番号", "事業者コード", "事業者ID"),
    "year": ("年度", "年次", "対象年度"),
    "permit_type": ("許可区分", "事業区分", "許可種別", "事業種別"),
    "prefecture": ("都道府県", "都道府県名", "管轄運輸"),
    "address": ("住所", "所在地", "事業者基本情報_住所"),
    "vehicle_count": ("車両数", "事業用自動車数"),
    "extended_actual_vehicle_count": ("延実在車両数",),
    "extended_working_vehicle_count": ("延実働車両数",),
    "actual_vehicle_km": ("実車キロ", "実車キロ数"),
    "total_vehicle_km": ("走行キロ", "走行距離"),
    "passenger_count": ("輸送人員", "輸送人数", "旅客数"),
    "revenue": ("営業収入", "運送収入", "運輸収入"),
    "sales_revenue": ("営業収入", "営業収益"),
    "transport_revenue": ("運送収入", "運輸収入"),
    "operating_expenses": ("営業費用", "営業経費"),
    "driver_count": ("運転者数", "運転者人数", "バス運転者数"),
    "employee_count": ("従業員数", "社員数", "職員数"),
}
VEHICLE_COUNT_EXCLUDED_MARKS = ("延実在", "延実働")

BLANK_MARKS = ("", "-", "－", "NA", "N/A", "null", "None")

EARTH_RADIUS_KM = 6371.0088
WINDOW_DAYS = 365
HISTORY_DAYS = {1: 365, 2: 730, 3: 1095}
YOY_GAP_DAYS = (365, 455)
YOY_BAND_DAYS = 90
FUZZY_THRESHOLD = 0.55
FUZZY_TOP_K = 3
VERDICT_MIN_OPERATORS = 20
MISSING_SELECTOR_NO = 999
SINGLE_AGENCY_ID = "__single__"

# Columns left out of the public catalogue snapshot.
REGISTRY_PRIVATE_COLUMNS = (
    "organization_email", "feed_memo", "feed_src_gtfs_current_url",
    "feed_src_gtfs_next_url", "feed_src_gtfs_web_url", "organization_web_url",
)

LINKS_UNAVAILABLE = "not_evaluable_LINKS_source_unavailable"

# --- end of fixed values ----------------------------------------------------

# Names the archive (one version of one feed) in every table.
ARCHIVE_KEYS = ("organization_id", "feed_id", "version_selector")
FEED_KEYS = ("organization_id", "feed_id")
WEEKDAY_COLUMNS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
