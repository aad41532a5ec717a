"""Schemas of the stages. Every record carries record_id, which orders the input; nothing relies on row order."""

from __future__ import annotations

from pyspark.sql import types as T

DURATION = "struct<start:string,end:string,is_current:boolean>"
EXPERIENCE = f"struct<company:string,title:string,duration:{DURATION},description:string,location:string>"
EDUCATION = f"struct<institution:string,degree:string,field_of_study:string,duration:{DURATION},gpa:double>"
LINK = "struct<url:string,label:string>"
ISSUE = "struct<field:string,severity:string,message:string,value:string>"
LISTS = {"skills": "array<string>", "experience": f"array<{EXPERIENCE}>", "education": f"array<{EDUCATION}>", "links": f"array<{LINK}>"}
SCALARS = ("name", "email", "phone", "location", "summary")
FIELDS = (*SCALARS, *LISTS)

#: A raw record: its fields in the order of the file; values of JSON records that are no strings are JSON text.
RAW = "record_id long, input_ord int, row_ord long, source string, source_file string, fields array<struct<key:string,value:string>>, raw_json string, raw_text string, parse_errors array<string>"
RECORD = (
    "record_id long, source string, source_file string, "
    + ", ".join(f"{c} string" for c in SCALARS)
    + ", "
    + ", ".join(f"{c} {t}" for c, t in LISTS.items())
    + ", extra_fields map<string,string>, parse_errors array<string>"
)


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)
