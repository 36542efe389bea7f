"""The driver's tables seen as form tables. The SQL is read by Spark and by DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A form as text: labels, and between bars the column that fills them in.
RENDERED = """\
Student Name: |n_name| Kumar
DOB: 0|cast(1 + c_custkey % 9 AS string)|/11/20|cast(10 + c_custkey % 10 AS string)
Gender: |CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'F' END
Category: |CASE c_custkey % 4 WHEN 0 THEN 'obc' ELSE 'General' END
Nationality: |n_name
Religion: |r_name
Aadhar No: |lpad(cast(c_custkey AS string), 12, '1')
Blood Group: AB+
Permanent Address: |cast(c_custkey AS string)| High Street, |n_name
Pincode: |lpad(cast(c_custkey AS string), 6, '5')
City: |r_name
State: |n_name
Phone: +91 |lpad(cast(c_custkey AS string), 10, '9')
Alternate Phone: |lpad(cast(c_custkey AS string), 10, '8')
Email: |lower(replace(c_name, '#', '.'))|@Mail.Example.COM
Emergency Contact: Ann |n_name
Emergency Phone: 080-|lpad(cast(c_custkey AS string), 8, '2')
Father: Bob |r_name
Father Occupation: Clerk
Father Phone: 9|lpad(cast(c_custkey AS string), 9, '7')
Mother: Eve |r_name
Mother Occupation: Nurse
Mother Phone: 8|lpad(cast(c_custkey AS string), 9, '6')
Guardian: Sam |r_name
Guardian Relation: Uncle
Guardian Phone: 7|lpad(cast(c_custkey AS string), 9, '4')
Annual Income: |cast(c_custkey * 1000 AS string)
10th Board: CBSE
10th Year: 2016
10th Percentage: |cast(c_custkey % 120 AS string)|.5
10th School: |n_name| School, Main
12th Board: ICSE
12th Year: 2018
12th Percentage: 88
12th School: St. |n_name
Qualification: Diploma
Graduation: BSc |n_name
Course: |c_mktsegment
Application No: APP-|cast(c_custkey AS string)
Roll No: R/|cast(c_custkey AS string)
Admission Date: 01.07.2019"""

SQL = {
    "forms": """
SELECT o_orderkey AS id, concat('form_', cast(o_orderkey AS string), CASE o_orderkey % 5 WHEN 0 THEN '_SRCC.pdf' WHEN 1 THEN ' Data Form.PNG' WHEN 2 THEN '.exe' ELSE '.jpg' END) AS filename,
  concat('uploads/', cast(o_orderkey AS string)) AS file_path, o_orderdate AS upload_date,
  CASE o_orderkey % 4 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'google' WHEN 2 THEN 'azure-vision' ELSE 'myOCR_own-ocr' END AS ocr_provider,
  CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'P' THEN 'extracted' ELSE 'uploaded' END AS status,
  o_custkey AS student_profile_id, c_name AS student_name, c_mktsegment AS course_applied, concat('ENR', cast(o_orderkey AS string)) AS enrollment_number, concat('APP-', cast(o_custkey AS string)) AS application_number,
  concat('+91', lpad(cast(c_custkey AS string), 10, '9')) AS phone_number, lower(concat(replace(c_name, '#', '.'), '@mail.example')) AS email,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lpad(cast(c_custkey AS string), 12, '0') END AS aadhar_number,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS verified_date, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "profiles": """
SELECT c_custkey AS id, c_name AS student_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lpad(cast(c_custkey AS string), 12, '0') END AS aadhar_number, last AS updated_date
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""",
    "docs": """
SELECT l_orderkey * 10 + l_linenumber AS id, concat('doc_', cast(l_orderkey AS string), '.pdf') AS filename, concat('docs/', cast(l_linenumber AS string)) AS file_path, l_shipdate AS upload_date,
  CASE l_linenumber % 7 WHEN 0 THEN 'ID Proof' WHEN 1 THEN 'Academic Certificate' WHEN 2 THEN 'Medical Certificate' WHEN 3 THEN 'Birth Certificate' WHEN 4 THEN 'Income Certificate' WHEN 5 THEN 'Caste Certificate' ELSE 'Other' END AS document_category,
  l_returnflag AS description, cast(round(l_extendedprice * 100) AS bigint) AS file_size, CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey + 1000000 ELSE l_orderkey END AS form_id,
  CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS student_profile_id
FROM lineitem""",
    "form_pages": """
SELECT conv_id AS form_id, cast(turn + 1 AS int) AS page, CASE WHEN turn % 5 = 3 THEN '' ELSE text END AS raw_text, cast((length(text) * 7) % 1000 AS double) / 10 AS confidence, role AS provider FROM conversations""",
    "attempts": """
SELECT l_orderkey AS form_id, 1 + l_linenumber % 2 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS attempt_ord, CASE l_suppkey % 4 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'google' WHEN 2 THEN 'aws-textract' ELSE 'abbyy' END AS provider,
  p_name AS raw_text, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity * 2 END AS confidence, CASE WHEN l_linenumber % 6 = 5 THEN 'Invalid image' END AS error
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "rendered": "SELECT c_custkey AS id, concat(" + ", chr(10), ".join(", ".join(p if k % 2 else f"'{p}'" for k, p in enumerate(line.split("|")) if p) for line in RENDERED.splitlines()) + """) AS raw_text
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df dealt evenly over tasks of so many rows at most, and over four a core: a narrow table's one file is often one task,
    however long the texts made of its rows."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A form table, or one of the driver's own."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    words = set(SQL[name].replace("\n", " ").replace("(", " ").split())
    sql, own = SQL[name], {}
    for t in TABLES:
        if t in words:
            own[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if (name, t) == ("rendered", "customer"):
                own[t] = spread(own[t])
            for before in ("FROM ", "JOIN "):
                sql = sql.replace(f"{before}{t}", f"{before}{{{t}}}")
    return spark.sql(sql, **own)


def duck(sql: str) -> str:
    """A query over the form tables, for DuckDB."""
    own = [n for n in SQL if f" {n} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ").replace("(", " ")]
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in own) + " " + sql) if own else sql
