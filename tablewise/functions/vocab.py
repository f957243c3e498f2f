"""Word lists and thresholds.

Everything in this file is a fixed value: results depend on exactly these words
and numbers, so they are stated plainly and in one place.
"""

# --- Fixed values: missing-value markers -------------------------------------
MISSING_EN = (
    "not provided", "not found", "not collected", "not available", "not applicable",
    "not determined", "not reported", "not recorded", "not specified",
    "restricted access", "missing", "unknown", "none", "null", "nil",
    "n/a", "n.a", "n.a.", "na", "n/a.",
)
MISSING_ZH = (
    "无", "暂无", "无数据", "未提供", "未填写", "未采集", "未记录", "未知", "不详", "缺失", "空",
)
MISSING_SYMBOLS = ("-", "--", "—", "－－", "/", ".")

# --- Fixed values: column-name keywords --------------------------------------
MONEY_NAMES = (
    "金额", "价格", "单价", "总价", "费用", "成本", "收入", "工资", "薪资", "奖金", "报销",
    "amount", "price", "cost", "fee", "salary", "income", "revenue", "total",
)
DATE_NAMES = ("日期", "时间", "date", "time", "day")
PHONE_NAMES = ("电话", "手机", "联系", "phone", "mobile", "tel")
CATEGORY_NAMES = (
    "状态", "类型", "类别", "分类", "区域", "地区", "级别", "等级", "性别",
    "status", "state", "type", "category", "region", "level", "grade", "gender",
)
IDENTIFIER_NAMES = ("编号", "单号", "编码", "代码", "号", "id", "no", "code", "name", "名称")
LONG_TEXT_NAMES = (
    "备注", "描述", "说明", "地址", "详情", "内容", "意见",
    "remark", "note", "description", "address", "comment",
)
PRICE_NAMES = ("单价", "价格", "售价", "price", "cost")
QUANTITY_NAMES = ("数量", "件数", "quantity", "qty", "count")
CONTACT_NAMES = (
    "地址", "联系人", "address", "contact", "电话", "手机", "联系", "phone", "mobile", "tel",
)
PRODUCT_ATTRIBUTE_NAMES = (
    "规格", "型号", "单位", "库存", "品牌", "条码",
    "spec", "model", "unit", "stock", "brand", "barcode",
)
PARTY_ID_NAMES = ("名称", "姓名", "name")

# --- Fixed values: table-name keywords ---------------------------------------
ORDER_TABLES = (
    "订单", "销售", "采购", "出库", "入库", "送货", "发货", "退货", "交易", "流水", "明细",
    "台账", "记录", "order", "sales", "sale", "purchase", "transaction", "delivery",
)
CUSTOMER_TABLES = (
    "客户", "顾客", "供应商", "供货商", "会员", "员工", "职员", "联系人", "商家", "厂商",
    "customer", "client", "supplier", "vendor", "member", "employee", "contact",
)
PRODUCT_TABLES = (
    "商品", "产品", "物料", "货品", "货物", "单品",
    "product", "item", "material", "goods", "sku",
)
DEFAULT_TABLE_NAME = r"(?i)^(?:sheet\s*\d*|worksheet\s*\d*|表\d*)$"
KIND_LABELS = {"order": "订单", "customer": "客户", "product": "商品", "unknown": "未命名实体"}

# --- Fixed values: cleaning --------------------------------------------------
TOTAL_WORDS = ("合计", "共计", "总计", "小计", "累计", "total", "sum", "grand total")
SEQUENCE_HEADERS = (
    "序号", "序", "序號", "编号", "編號", "编码", "行号", "行號", "项次",
    "no", "no.", "#", "num", "number", "index", "idx",
)
NOTE_PREFIXES = (
    "注：", "注:", "备注：", "备注:", "说明：", "说明:",
    "特别说明", "温馨提示", "小贴士", "注意", "※",
)
EMOJI = r"^[\x{1F300}-\x{1FAFF}☀-➿⬀-⯿]"
DELIMITERS = (",", "\t", ";")
HEADER_SCAN_ROWS = 10
FILL_WINDOW_ROWS = 20
HEADER_LOW_SCORE = 0.70
SEQUENCE_MIN_RUN = 3
MAX_COLUMNS = 200

# --- Fixed values: profiling, inference and links ----------------------------
SAMPLE_ROWS = 100
TOP_VALUES = 5
PREVIEW_ROWS = 20
PREVIEW_CHARS = 80
CONFIDENCE_HIGH = 0.85
CONFIDENCE_MEDIUM = 0.60
MIN_TYPE_RATIO = 0.60
ENUM_MAX_DISTINCT = 20
ENUM_MAX_RATIO = 0.5
ENUM_MIN_VALUES = 3
ENUM_LABEL_CHARS = 16
ENUM_LABEL_AVG_CHARS = 8
ID_MAX_NULL_RATIO = 0.05
LONG_TEXT_AVG_CHARS = 12
KEY_MIN_PRESENT = 0.95
KEY_MIN_DISTINCT = 0.95
FOREIGN_KEY_CONFIDENCE = 0.63
POSITIONAL_KEY_CONFIDENCE = 0.5
COUNT_METRIC_CONFIDENCE = 0.9
SUM_METRIC_CONFIDENCE = 0.8
MAX_LIST_COLUMNS = 6
MAX_FILTERS = 4
DEFINITION_CHARS = 120
CURRENCY = "¥￥$€￠£"
FIELD_TYPES = ("string", "number", "money", "date", "enum", "phone")
FIELD_ROLES = ("identifier", "dimension", "measure", "time", "enum", "text")

# --- Fixed values: queries ---------------------------------------------------
PAGE_SIZE = 10
EMPTY_FILTER = "__empty__"
EMPTY_LABEL = "（空）"
RECENT_ROWS = 5
TREND_MONTHS = 6
DISTRIBUTION_ITEMS = 6
RELATED_ROWS = 5

# --- Fixed values: column name -> stable key ---------------------------------
FIELD_KEYS = {
    "订单编号": "order_no", "订单号": "order_no", "单号": "order_no",
    "客户编号": "customer_id", "客户名称": "customer_name", "客户名": "customer_name",
    "客户": "customer_name",
    "商品编号": "product_id", "产品编号": "product_id",
    "商品名称": "product_name", "产品名称": "product_name", "商品名": "product_name",
    "供应商名称": "supplier_name", "供应商": "supplier_name",
    "编号": "id", "id": "id", "名称": "name", "姓名": "name",
    "金额": "amount", "总金额": "amount", "订单金额": "amount",
    "单价": "unit_price", "价格": "price", "售价": "price",
    "数量": "quantity", "库存数量": "stock_quantity", "库存": "stock",
    "下单日期": "order_date", "付款日期": "payment_date", "日期": "date", "时间": "time",
    "区域": "region", "地区": "region", "所属区域": "region",
    "状态": "status", "类型": "type", "类别": "category", "分类": "category",
    "性别": "gender", "级别": "level", "等级": "level", "负责人": "owner", "联系人": "contact",
    "联系电话": "phone", "电话": "phone", "手机": "phone", "手机号": "phone",
    "地址": "address", "收货地址": "address",
    "备注": "remark", "描述": "description", "说明": "note",
    "规格": "spec", "型号": "model", "单位": "unit", "品牌": "brand",
}

# --- Fixed values: accepted spellings, as patterns --------------------------------
NUMBER = r"(?U)^[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?$"
MONEY = (
    rf"(?U)^[{CURRENCY}]?\s*[+-]?(?:\d{{1,3}}(?:,\d{{3}})*|\d+)(?:\.\d+)?\s*[{CURRENCY}元块]?$"
)
MONEY_MARK = rf"[{CURRENCY}]|[元块]$"
PHONE = r"(?U)^(?:(?:\+?86)?1[3-9]\d{9}|0\d{2,3}\d{7,8})$"
CLOCK = r"T(?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d(?:\.\d{1,6})?"
FULL_DATE = (
    rf"^(?!0000)\d{{4}}(?:-\d{{1,2}}-\d{{1,2}}(?:{CLOCK})?"
    r"|/\d{1,2}/\d{1,2}|\.\d{1,2}\.\d{1,2}|年\d{1,2}月\d{1,2}日)$"
)
PERIOD = r"^(?:19|20|21)\d{2}(?:[-/.]\d{1,2}|年\d{1,2}月?)?$"
ANY_PERIOD = r"^(?!0000)\d{4}(?:[-/.]\d{1,2}|年(?:\d{1,2}月?)?)?$"
FLOAT = r"^[+-]?(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"
