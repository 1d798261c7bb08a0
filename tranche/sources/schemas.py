"""Layouts of the two loan files and the code sets of their status fields."""

from __future__ import annotations

# The published field order of the files. Kinds: text, double, int, month (MM/YYYY), day (MM/DD/YYYY).
ACQUISITION = [
    ("loan_id", "text"), ("channel", "text"), ("seller", "text"), ("orig_rate", "double"), ("orig_upb", "double"),
    ("orig_term", "int"), ("orig_date", "month"), ("first_pay_date", "month"), ("oltv", "double"), ("ocltv", "double"),
    ("num_borrowers", "int"), ("dti", "double"), ("fico", "int"), ("first_time_buyer", "text"), ("purpose", "text"),
    ("property_type", "text"), ("num_units", "int"), ("occupancy", "text"), ("state", "text"), ("zip3", "text"),
    ("mi_pct", "double"), ("product", "text"), ("co_fico", "int"), ("mi_type", "text"), ("relocation_flag", "text"),
]
PERFORMANCE = [
    ("loan_id", "text"), ("period", "day"), ("servicer", "text"), ("cur_rate", "double"), ("cur_upb", "double"),
    ("loan_age", "int"), ("months_to_maturity", "int"), ("adj_months_to_maturity", "int"), ("maturity_date", "month"), ("msa", "text"),
    ("dlq_status", "text"), ("modification_flag", "text"), ("zb_code", "text"), ("zb_date", "month"), ("lpi_date", "day"),
    ("foreclosure_date", "day"), ("disposition_date", "day"), ("foreclosure_costs", "double"), ("preservation_costs", "double"), ("asset_recovery_costs", "double"),
    ("misc_holding_expenses", "double"), ("holding_taxes", "double"), ("net_sale_proceeds", "double"), ("credit_enhancement_proceeds", "double"), ("repurchase_make_whole_proceeds", "double"),
    ("other_foreclosure_proceeds", "double"), ("non_interest_bearing_upb", "double"), ("principal_forgiveness", "double"), ("rmw_proceeds_flag", "text"), ("foreclosure_writeoff", "double"),
    ("servicing_indicator", "text"),
]
#: Zero-balance codes of a credit event and of a prepayment.
DEFAULT_CODES = ("02", "03", "09", "15")
PREPAY_CODES = ("01",)
#: Months past due that count as D90 and D180.
D90, D180 = 3, 6

TYPES = {"text": "string", "double": "double", "int": "int", "month": "date", "day": "date"}
