"""Fixed table schemas; ingestion conforms to these instead of inferring."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
    "date": T.DateType(), "money": T.DecimalType(18, 4), "percent": T.DecimalType(9, 4),
}


def _struct(spec: str) -> T.StructType:
    # no DDL parsing here: that needs a running session, and this module is imported without one
    pairs = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SALES = _struct(
    "status_date date, item string, item_desc string, sales double, "
    "total_price double, order_status string, unit string"
)

STOCK_LOG = _struct(
    "cur_date date, inv_mov_type string, doc_no string, cust_id string, cust_name string, "
    "supply_id string, supply_name string, warehouse_name string, item string, desc_he string, "
    "quantity double, unit string, UCOST double, COST double, USECONDCOST double, "
    "SECONDCOST double, coin string, to_warehouse_name string, general_item string, "
    "update_date date, trans_id string, line_id string, type string"
)

SUPPLY_ORDERS = _struct(
    "order_id string, supply_id int, supply_name string, date date, supply_order string, "
    "status string, total_price money, discount_perc percent, coin string, "
    "total_price_ILS money, details string"
)

ORDERS = _struct(
    "order_id string, cust_id string, status_date date, order_status string, "
    "total_price_with_discount double"
)

CUSTOMERS = _struct("cust_id string, country string, address string, state string")

SALES_PER_MONTH = _struct("item string, item_desc string, sales double, date string")

PANEL = _struct("ds date, unique_id string, y double")

SWA_RESULTS = _struct(
    "ds date, unique_id string, y double, s int, w int, SWA_value double, MAE double, MAPE double"
)

# Headers of the ERP line export and the column names they map to.
ERP_HEADERS = {
    "תאריך אסמכתא": "date",
    "תאריך אספקה לשורה": "date_supply",
    "קוד פריט": "sku",
    "כמות": "quantity",
    "% הנחה לשורה": "discount_percentage",
    "מחיר לאחר הנחה": "price_after_discount",
    "מחיר יחידה": "price_per_unit",
    "קוד איש מכירות": "code_sales_person",
    "תיאור הפריט/שירות": "description_sku",
    'מק"ט יצרן': "code_manufacturer",
    "סך הכול בשורה": "total_in_line",
    "מדינה/אזור יעד לייבוא": "county_destination",
    "מדינה/אזור מקור לייצוא": "county_origin",
    "סוג משלוח": "delivery_type",
}

# Columns of the cleaned ERP table, before the derived amount.
ERP_KEPT = [
    "date", "date_supply", "sku", "quantity", "discount_percentage", "price_after_discount",
    "price_per_unit", "code_sales_person", "description_sku", "code_manufacturer",
    "total_in_line", "delivery_type",
]

# Headers of the monthly feed and the months its columns stand for.
FEED_HEADERS = {"קוד פריוריטי": "item", "תיאור פריט": "desc_he"}
FEED_MONTHS = {
    "5": "2023-05-01", "6": "2023-06-01", "7": "2023-07-01", "8": "2023-08-01",
    "9": "2023-09-01", "10": "2023-10-01", "11": "2023-11-01", "12": "2023-12-01",
    "1": "2024-01-01", "2": "2024-02-01", "3": "2024-03-01", "4": "2024-04-01",
}

# Number columns of the inventory log.
INVENTORY_NUMBERS = [
    "TQUANT", "QUANT", "UCOST", "COST", "USECONDCOST", "SECONDCOST", "NUMPACK", "DOC", "TRANS",
    "KLINE",
]

# Movement types of the stock log.
MOVEMENT_RETURN = "החזרה מלקוח"
MOVEMENT_INVOICE = "חשבוניות מס"
MOVEMENT_INVOICE_RECEIPT = "חשבוניות מס קבלה"
MOVEMENT_FEED = "דאטה מסאפ"
MOVEMENT_DELIVERY = "משלוחים ללקוח"
OUTGOING_MOVEMENTS = [
    MOVEMENT_DELIVERY, MOVEMENT_INVOICE, MOVEMENT_INVOICE_RECEIPT, MOVEMENT_FEED,
]
DEMAND_MOVEMENTS = [MOVEMENT_RETURN, MOVEMENT_INVOICE, MOVEMENT_FEED, MOVEMENT_DELIVERY]

# Words looked for in item descriptions.
MATERIAL_WORDS = {"leather": "עור", "fabric": "בד"}
COLOR_WORDS = {
    "blue": "כחול", "brown": "חום", "red": "אדום", "green": "ירוק", "yellow": "צהוב",
    "black": "שחור", "white": "לבן", "gray": "אפור",
}
MANY_COLORS = "more than 1 color"
NO_COLOR = "other"

# Conversion rates of the spend reports.
HOME_RATES = {"ILS": 1.0, "USD": 3.7, "EUR": 4.0}
