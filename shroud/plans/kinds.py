"""Dimensions: kinds of personal data, where a finding comes from, and how sure it is. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Kind, and the word that stands for it in a token.
KINDS = {
    "Person": "PERSON", "Company": "COMPANY", "Phone": "PHONE", "Email": "EMAIL", "Address": "ADDRESS", "Iban": "IBAN",
    "Bic": "BIC", "Account": "ACCOUNT", "CustomerNo": "CUSTOMER", "TaxId": "TAX", "IdCard": "IDCARD", "Vehicle": "VEHICLE",
    "Birthdate": "BIRTHDATE", "EmployeeNo": "EMPLOYEE", "SocialInsuranceNo": "SOCIAL", "Contract": "CONTRACT",
    "Amount": "AMOUNT", "Date": "DATE", "Custom": "CUSTOM",
}
# The order in which sources win at the same place.
SOURCES = {"GeneralRule": 0, "Vault": 1, "LanguagePack": 2, "Hand": 3}
AUTO, SUGGEST = "auto", "suggest"
STATES = {AUTO: "Protected", SUGGEST: "Suggested"}


def kinds(spark: SparkSession) -> DataFrame:
    """kind, word: a row a kind."""
    return spark.createDataFrame(list(KINDS.items()), "kind string, word string")
