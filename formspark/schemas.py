"""Names and schemas of the form tables."""

from __future__ import annotations

# The fields of a form, in the order of its table, and the two enumerations.
GROUPS = {
    "basic": ("student_name", "date_of_birth", "gender", "category", "nationality", "religion", "aadhar_number", "blood_group"),
    "address": ("permanent_address", "correspondence_address", "pincode", "city", "state"),
    "contact": ("phone_number", "alternate_phone", "email", "emergency_contact_name", "emergency_contact_phone"),
    "guardian": ("father_name", "father_occupation", "father_phone", "mother_name", "mother_occupation", "mother_phone", "guardian_name", "guardian_relation", "guardian_phone", "annual_income"),
    "education": ("tenth_board", "tenth_year", "tenth_percentage", "tenth_school", "twelfth_board", "twelfth_year", "twelfth_percentage", "twelfth_school", "previous_qualification", "graduation_details"),
    "course": ("course_applied", "application_number", "enrollment_number", "admission_date"),
}
STATUSES = ("uploaded", "extracting", "extracted", "verified", "error")
CATEGORIES = ("ID Proof", "Academic Certificate", "Medical Certificate", "Birth Certificate", "Income Certificate", "Caste Certificate", "Other")

FIELDS = tuple(f for names in GROUPS.values() for f in names)
EXTRACTED = "raw_text STRING, confidence DOUBLE, structured_data MAP<STRING,STRING>, provider STRING, word_count INT, psm_mode INT, pages_processed INT, page_results ARRAY<STRUCT<page: INT, raw_text: STRING, confidence: DOUBLE, provider: STRING>>"
FORMS = (
    "id BIGINT NOT NULL, filename STRING NOT NULL, file_path STRING NOT NULL, upload_date TIMESTAMP, ocr_provider STRING NOT NULL, status STRING, student_profile_id BIGINT, "
    f"extracted_data STRUCT<{EXTRACTED.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' MAP', ': MAP').replace(' INT,', ': INT,').replace(' ARRAY', ': ARRAY').replace(':: ', ': ')}>, "
    + ", ".join(f"{f} STRING" for f in FIELDS)
    + ", additional_info MAP<STRING,STRING>, verified_date TIMESTAMP, verified_by STRING"
)
PROFILES = "id BIGINT, student_name STRING NOT NULL, aadhar_number STRING, created_date TIMESTAMP, updated_date TIMESTAMP"
DOCUMENTS = "id BIGINT, filename STRING, file_path STRING, upload_date TIMESTAMP, document_category STRING, description STRING, file_size BIGINT, form_id BIGINT, student_profile_id BIGINT"
ATTEMPTS = "form_id BIGINT, page INT, attempt_ord INT, provider STRING, raw_text STRING, confidence DOUBLE, structured_data MAP<STRING,STRING>, error STRING"
PAGES = "form_id BIGINT, page INT, raw_text STRING, confidence DOUBLE, provider STRING"
ANNOTATIONS = "file STRING, filename STRING, form_type STRING, fields MAP<STRING,STRING>, confidence MAP<STRING,DOUBLE>, notes STRING"

SUMMARY = ("id", "filename", "upload_date", "status", "ocr_provider", "student_profile_id")
DETAIL = (*SUMMARY, "extracted_data", *FIELDS, "additional_info", "verified_date", "documents")
DOCUMENT_VIEW = ("id", "filename", "document_category", "description", "upload_date", "file_size", "form_id", "student_profile_id", "file_path")


def export_label(name: str) -> str:
    """Display label of an export column."""
    special = {"id": "Form ID", "ocr_provider": "OCR Provider", "student_profile_id": "Student Profile ID", "date_of_birth": "Date of Birth"}
    return special.get(name) or name.replace("tenth", "10th").replace("twelfth", "12th").replace("_", " ").title().replace("Th ", "th ")


EXPORT = ("id", "filename", "status", "ocr_provider", "student_profile_id", "upload_date", "verified_date", "verified_by", *FIELDS[:10], "city", "state", "pincode", *FIELDS[13:], "additional_info")
