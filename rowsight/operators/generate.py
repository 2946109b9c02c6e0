"""Seeded business tables for trials: customers, products, invoices.

Every value is a hash of the row's id, so rows come out the same whatever the
partitioning. ``ids`` is any table with a unique bigint ``id``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import col, digest, digest_number
from .inject import inject_duplicates, inject_nulls, inject_outliers, near_duplicates, with_dense_index

# fixed values: enumerations and ranges of the business tables
GENDERS = ["M", "F", "Other"]
SEGMENTS = ["Premium", "Standard", "Basic", "Trial"]
CURRENCIES = ["USD", "EUR", "GBP"]
SIZES = ["XS", "S", "M", "L", "XL", "XXL", "N/A"]
MATERIALS = ["Cotton", "Plastic", "Metal", "Wood", "Glass", "Leather", "Synthetic"]
STATUSES = ["Paid", "Pending", "Overdue", "Cancelled", "Processing", "Refunded"]
PAYMENTS = ["Credit Card", "Debit Card", "PayPal", "Bank Transfer", "Cash", "Check"]
CATEGORIES = {
    "Electronics": (50, 2000),
    "Clothing": (10, 300),
    "Home & Garden": (15, 500),
    "Sports & Outdoors": (20, 800),
    "Books": (5, 50),
    "Toys & Games": (10, 150),
    "Beauty & Health": (8, 200),
    "Automotive": (25, 1000),
    "Food & Beverages": (2, 100),
    "Office Supplies": (5, 300),
}

# own word lists for invented names
FIRST = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo", "Ida", "Jon", "Kai", "Lena", "Mia", "Nils", "Ona", "Paul"]
LAST = ["Abel", "Brook", "Carver", "Dale", "Ebert", "Field", "Grove", "Hart", "Iven", "Jarvis", "Kent", "Lorne", "Marsh", "North"]
WORDS = ["amber", "basin", "cedar", "delta", "ember", "flint", "grain", "harbor", "inlet", "juniper", "kettle", "ledge", "meadow", "nectar"]
CITIES = ["Ashford", "Brookton", "Calder", "Dunmore", "Elmsted", "Farrow", "Glenby", "Holt"]
STATES = ["Avon", "Borders", "Coast", "Downs", "East", "Fells"]
COUNTRIES = ["Austria", "Brazil", "Canada", "Denmark", "Egypt", "France", "Ghana", "India"]
JOBS = ["Analyst", "Baker", "Clerk", "Driver", "Editor", "Farmer", "Guide", "Joiner"]
COLORS = ["Red", "Orange", "Yellow", "Green", "Blue", "Indigo", "Violet", "Grey"]


class _Draw:
    """Values of a row drawn by digests, as any engine with md5 draws them: uniform, whole, choice, text."""

    def __init__(self, key: Column, seed: int):
        self.key, self.seed = key, seed

    def uniform(self, salt: str) -> Column:
        return digest_number(digest([self.key], f"{salt}:{self.seed}")) / F.lit(float(1 << 52))

    def real(self, salt: str, low: float, high: float, digits: int = 2) -> Column:
        return F.round(self.uniform(salt) * (high - low) + low, digits)

    def whole(self, salt: str, low: int, high: int) -> Column:
        return (F.floor(self.uniform(salt) * (high - low + 1)) + low).cast("int")

    def choice(self, salt: str, options: list) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), self.whole(salt, 1, len(options)))

    def words(self, salt: str, n: int) -> Column:
        return F.concat_ws(" ", *[self.choice(f"{salt}{i}", WORDS) for i in range(n)])

    def company(self, salt: str) -> Column:
        return F.concat_ws(" ", self.choice(salt, LAST), self.choice(salt + "2", ["Group", "Ltd", "and Sons", "Partners"]))

    def address(self, salt: str) -> Column:
        return F.concat(
            self.whole(salt, 1, 9999).cast("string"), F.lit(" "), F.initcap(self.choice(salt + "s", WORDS)),
            F.lit(" Street, "), self.choice(salt + "c", CITIES), F.lit(" "), F.lpad(self.whole(salt + "z", 0, 99999).cast("string"), 5, "0"),
        )

    def day(self, salt: str, last: Column, span: int) -> Column:
        return F.date_sub(last, self.whole(salt, 0, span))


def row_ids(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(1, rows + 1)


def _extra(ids: DataFrame) -> list[str]:
    """Columns of ``ids`` to carry along."""
    return [c for c in ids.columns if c != "id"]


def customers(ids: DataFrame, as_of: dt.date, seed: int = 42) -> DataFrame:
    """22 columns; income rises with age and never falls below 0."""
    r, today = _Draw(F.col("id"), seed), F.lit(as_of)
    age = r.whole("age", 18, 85)
    income = F.greatest(F.lit(0), r.whole("income", 25000, 150000) + (age - 30) * r.whole("slope", 500, 2000))
    first, last = r.choice("first", FIRST), r.choice("last", LAST)
    return ids.select(
        F.col("id").alias("customer_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), F.col("id").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-"), F.lpad(r.whole("phone", 0, 9999999).cast("string"), 7, "0")).alias("phone"),
        r.address("home").alias("address"),
        r.choice("city", CITIES).alias("city"),
        r.choice("state", STATES).alias("state"),
        F.lpad(r.whole("zip", 0, 99999).cast("string"), 5, "0").alias("zip_code"),
        r.choice("country", COUNTRIES).alias("country"),
        F.date_sub(today, r.whole("birth", 18 * 365 + 5, 85 * 365)).alias("date_of_birth"),
        age.alias("age"),
        r.choice("gender", GENDERS).alias("gender"),
        r.company("employer").alias("company"),
        r.choice("job", JOBS).alias("job_title"),
        income.cast("double").alias("income"),
        r.real("balance", -5000.0, 50000.0).cast("decimal(12,2)").alias("account_balance"),
        r.whole("score", 300, 850).alias("credit_score"),
        r.day("registered", today, 5 * 365).alias("registration_date"),
        r.day("login", today, 90).alias("last_login"),
        (r.uniform("active") < 0.5).alias("is_active"),
        r.choice("segment", SEGMENTS).alias("customer_segment"),
        *_extra(ids),
    )


def products(ids: DataFrame, as_of: dt.date, seed: int = 42) -> DataFrame:
    """25 columns; price within its category's range, cost 70-90 % of it."""
    r, today = _Draw(F.col("id"), seed), F.lit(as_of)
    ranges = F.map_from_arrays(
        F.array(*[F.lit(c) for c in CATEGORIES]),
        F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for a, b in CATEGORIES.values()]),
    )
    base = ids.withColumn("category", r.choice("category", list(CATEGORIES)))
    bounds = F.element_at(ranges, F.col("category"))
    base = base.withColumn("price", F.round(r.uniform("price") * (bounds["high"] - bounds["low"]) + bounds["low"], 2))
    base = base.withColumn("stock_quantity", r.whole("stock", 0, 1000)).withColumn("created_date", r.day("created", today, 3 * 365))
    side = [r.whole(f"side{i}", 5, 100).cast("string") for i in range(3)]
    return base.select(
        F.col("id").alias("product_id"),
        F.concat(F.lit("SKU-"), r.whole("sku", 100000, 999999).cast("string")).alias("sku"),
        F.initcap(r.words("name", 3)).alias("product_name"),
        F.when(r.uniform("long") > 0.1, r.words("text", 24)).otherwise(r.words("text", 6)).alias("description"),
        "category",
        F.initcap(r.choice("sub", WORDS)).alias("subcategory"),
        r.company("brand").alias("brand"),
        r.company("supplier").alias("supplier"),
        "price",
        F.round(F.col("price") * (r.uniform("cost") * 0.2 + 0.7), 2).alias("cost"),
        r.choice("currency", CURRENCIES).alias("currency"),
        "stock_quantity",
        r.whole("reorder", 10, 100).alias("reorder_level"),
        r.real("weight", 0.1, 50.0).alias("weight"),
        F.concat(side[0], F.lit("x"), side[1], F.lit("x"), side[2], F.lit(" cm")).alias("dimensions"),
        r.choice("color", COLORS).alias("color"),
        r.choice("size", SIZES).alias("size"),
        r.choice("material", MATERIALS).alias("material"),
        r.real("rating", 1.0, 5.0, 1).alias("rating"),
        r.whole("reviews", 0, 5000).alias("review_count"),
        (F.col("stock_quantity") > 0).alias("is_available"),
        (r.uniform("featured") < 0.5).alias("is_featured"),
        r.real("discount", 0.0, 30.0, 1).alias("discount_percentage"),
        "created_date",
        F.date_add("created_date", F.floor(r.uniform("updated") * (F.datediff(today, "created_date") + 1)).cast("int")).alias("last_updated"),
        *_extra(ids),
    )


# fixed values: defect rates of the business tables
CUSTOMER_NULLS = {"email": 0.12, "phone": 0.15, "address": 0.08, "company": 0.18}
CUSTOMER_OUTLIERS = {
    "age": {"rate": 0.05, "min": 150, "max": 999},
    "income": {"rate": 0.04, "min": -50000, "max": -1000},
    "account_balance": {"rate": 0.03, "value": 999999999.99},
}
PRODUCT_NULLS = {"description": 0.15, "brand": 0.12, "supplier": 0.18, "weight": 0.10}
PRODUCT_OUTLIERS = {
    "price": {"rate": 0.05, "min": -500, "max": -10},
    "stock_quantity": {"rate": 0.04, "min": -1000, "max": -1},
    "weight": {"rate": 0.03, "value": 999999.99},
    "rating": {"rate": 0.05, "min": 10.0, "max": 99.9},
}
INVOICE_NULLS = {
    "customer_company": 0.20, "billing_address": 0.15, "shipping_address": 0.18, "payment_method": 0.08,
    "discount_amount": 0.65, "tax_amount": 0.05, "notes": 0.75, "due_date": 0.12,
}
INVOICE_OUTLIERS = {
    "quantity": {"rate": 0.03, "choices": [-10, 15000]},
    "unit_price": {"rate": 0.025, "choices": [-100.0, 75000.0]},
    "total_amount": {"rate": 0.02, "choices": [-2000.0, 800000.0]},
    "discount_amount": {"rate": 0.015, "choices": [-500.0, 2000.0]},
    "tax_rate": {"rate": 0.03, "choices": [-10.0, 75.0]},
}


def copied_ids(ids: DataFrame, duplicate_rate: float, seed: int = 42) -> DataFrame:
    """(id, copy): the ids and as many drawn copies that they make up
    ``duplicate_rate`` of the result. Drawn by digests, so a rerun draws the same."""
    drawn = inject_duplicates(ids.select("id"), duplicate_rate, ["id"], seed, of_result=True)
    # a row is drawn a handful of times at most
    return drawn.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("id")))


def _spoiled(make, id_column: str, copied: DataFrame, as_of, seed, nulls, outliers) -> DataFrame:
    key = [id_column, "copy"]
    keys = copied.select(F.col("id").alias(id_column), "copy")
    blanked = inject_nulls(make(copied, as_of, seed), nulls, key, seed, keys=keys)
    return inject_outliers(blanked, outliers, key, seed, keys=keys).drop("copy")


def dirty_customers(
    ids: DataFrame, as_of: dt.date, duplicate_rate: float = 0.08, seed: int = 42, nulls: dict = CUSTOMER_NULLS, outliers: dict = CUSTOMER_OUTLIERS,
) -> DataFrame:
    """Customers with copies first, then nulls, then outliers, so some copies differ."""
    return _spoiled(customers, "customer_id", copied_ids(ids, duplicate_rate, seed), as_of, seed, nulls, outliers)


def dirty_products(
    ids: DataFrame, as_of: dt.date, duplicate_rate: float = 0.08, seed: int = 42, nulls: dict = PRODUCT_NULLS, outliers: dict = PRODUCT_OUTLIERS,
) -> DataFrame:
    return _spoiled(products, "product_id", copied_ids(ids, duplicate_rate, seed), as_of, seed, nulls, outliers)


def invoices(
    ids: DataFrame, customer_ids: DataFrame, product_ids: DataFrame, as_of: dt.date, seed: int = 42,
    nulls: dict | None = None, outliers: dict | None = None,
) -> DataFrame:
    """20 columns; each invoice refers to a drawn customer and product.

    Ids are numbered densely and drawn by number, so both look-ups are equi-joins
    on evenly spread keys. ``nulls`` and ``outliers`` act on single values while
    the amounts are derived, as rates (not exact counts).
    """
    nulls, outliers = nulls or {}, outliers or {}
    r, today = _Draw(F.col("id"), seed), F.lit(as_of)

    def gone(name):
        return r.uniform(f"null:{name}") < nulls.get(name, 0.0)

    def odd(value, name):
        c = outliers.get(name)
        if not c:
            return value
        hit = r.uniform(f"odd:{name}") < c["rate"]
        return F.when(hit, r.choice(f"pick:{name}", c["choices"])).otherwise(value)

    def numbered(keys: DataFrame, name: str) -> tuple[DataFrame, Column]:
        keys = keys.select(col(keys.columns[0]).alias(name)).distinct()
        total = keys.agg(F.count(F.lit(1)).alias("n")).scalar()
        pick = (F.floor(r.uniform(f"ref:{name}") * total) + 1).alias(f"{name}_no")
        return with_dense_index(keys, [name], f"ref:{seed}", f"{name}_no"), pick

    customers_no, customer_pick = numbered(customer_ids, "customer_id")
    products_no, product_pick = numbered(product_ids, "product_id")
    drawn = (
        ids.select("id", customer_pick, product_pick)
        .join(customers_no, "customer_id_no")
        .join(products_no, "product_id_no")
        # rows are few bytes here and much work after: dealt to a number of tasks that doesn't follow from their size
        .repartition(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    )
    rows = (
        drawn.withColumn("invoice_date", r.day("invoice", today, 2 * 365))
        .withColumn("quantity", odd(r.whole("quantity", 1, 10), "quantity").cast("int"))
        .withColumn("unit_price", odd(r.real("price", 5.0, 500.0), "unit_price"))
        .withColumn("gross", F.col("quantity") * F.col("unit_price"))
        .withColumn("discount_amount", F.when(~gone("discount_amount"), odd(F.round(F.col("gross") * (r.uniform("discount") * 0.2 + 0.05), 2), "discount_amount")))
        .withColumn("net", F.col("gross") - F.coalesce("discount_amount", F.lit(0.0)))
        .withColumn("tax_rate", F.when(~gone("tax_amount"), odd(r.real("tax", 0.05, 0.15, 4), "tax_rate")))
        .withColumn("tax_amount", F.round(F.col("net") * F.col("tax_rate"), 2))
        .withColumn("total_amount", odd(F.round(F.col("net") + F.coalesce("tax_amount", F.lit(0.0)), 2), "total_amount"))
    )

    def moment(salt):
        seconds = F.greatest(F.datediff(today, F.col("invoice_date")), F.lit(1)) * 86400
        return (F.col("invoice_date").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(r.uniform(salt) * seconds))).alias(salt)

    return rows.select(
        F.col("id").alias("invoice_id"), "customer_id", "product_id", "invoice_date",
        F.when(~gone("due_date"), F.date_add("invoice_date", r.whole("due", 15, 60))).alias("due_date"),
        "quantity",
        F.col("unit_price").cast("decimal(12,2)").alias("unit_price"),
        F.round("gross", 2).cast("decimal(14,2)").alias("subtotal"),
        F.col("discount_amount").cast("decimal(12,2)").alias("discount_amount"),
        F.col("tax_rate").cast("decimal(8,4)").alias("tax_rate"),
        F.col("tax_amount").cast("decimal(14,2)").alias("tax_amount"),
        F.col("total_amount").cast("decimal(14,2)").alias("total_amount"),
        r.choice("status", STATUSES).alias("invoice_status"),
        F.when(~gone("payment_method"), r.choice("payment", PAYMENTS)).alias("payment_method"),
        F.when(~gone("customer_company"), r.company("buyer")).alias("customer_company"),
        F.when(~gone("billing_address"), r.address("bill")).alias("billing_address"),
        F.when(~gone("shipping_address"), r.address("ship")).alias("shipping_address"),
        F.when(~gone("notes"), r.words("note", 12)).alias("notes"),
        moment("created_at"), moment("updated_at"),
    )


def dirty_invoices(
    ids: DataFrame, customer_ids: DataFrame, product_ids: DataFrame, as_of: dt.date,
    duplicate_rate: float = 0.08, seed: int = 42, nulls: dict = INVOICE_NULLS, outliers: dict = INVOICE_OUTLIERS,
) -> DataFrame:
    """Invoices with value defects and near duplicates under new ids."""
    made = invoices(ids, customer_ids, product_ids, as_of, seed, nulls, outliers)
    return near_duplicates(made, duplicate_rate, "invoice_id", "invoice_date", seed=seed, of_result=True)
