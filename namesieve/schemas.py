"""Explicit schemas. List data is text throughout, as the publishers deliver it."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


# Column names and their order in the published and normalised files.
NORMALIZED = (
    "source source_file dataid reference_number list_type record_type name first_name middle_name "
    "last_name aliases nationalities gender pob_cities pob_countries dob_dates dob_years addresses "
    "id_numbers program comments listed_on last_updated processing_date un_list_type"
).split()
NORMALIZED_SHORT = [c for c in NORMALIZED if c not in ("listed_on", "un_list_type")]
EU_NORMALIZED = (
    "source source_file record_type dataid reference_number name first_name second_name third_name "
    "fourth_name aliases gender title function nationalities pob_cities pob_countries pob_regions "
    "addresses countries regions cities dob_dates dob_years listed_on last_updated updated_at "
    "un_list_type list_type program regulations reference_url comments id_numbers additional_info "
    "authority authority_uri reason source_information_url source_list_url source_name source_type "
    "source_updated_at source_created_at source_updated_in_db source_created_in_db "
    "source_type_description source_description source_url source_aliases source_remarks "
    "is_individual is_entity is_vessel is_government is_organization is_other is_active is_removed"
).split()
REQUIRED = ["source", "record_type", "dataid", "name"]
SEARCH_STRINGS = (
    "aliases nationalities pob_cities pob_countries dob_dates dob_years comments addresses listed_on "
    "last_updated processing_date first_name middle_name last_name un_list_type list_type program "
    "gender id_numbers reference_number source_file"
).split()
OFAC_SDN = (
    "ent_num sdn_name sdn_type program title call_sign vess_type vess_flag vess_owner remarks col11 col12"
).split()
OFAC_ALT = "ent_num alt_type alt_name alt_reg_date col5".split()
OFAC_ADD = "ent_num address_type address city_state_zip country add_reg_date".split()
UK_COLUMNS = [
    "Unique ID",
    "OFSI Group ID",
    "Name",
    "Type",
    "Regime Name",
    "Sanctions Imposed",
    "Designation Source",
]
EU_COLUMNS = (
    "fileGenerationDate Entity_LogicalId Entity_SubjectType Entity_EU_ReferenceNumber "
    "Entity_UnitedNationId Entity_DesignationDate Entity_DesignationDetails Entity_Remark "
    "Entity_Regulation_Programme Entity_Regulation_NumberTitle Entity_Regulation_PublicationDate "
    "Entity_Regulation_EntryIntoForceDate NameAlias_WholeName NameAlias_FirstName "
    "NameAlias_MiddleName NameAlias_LastName NameAlias_Gender NameAlias_Title NameAlias_Function "
    "NameAlias_Regulation_Programme NameAlias_Regulation_PublicationDate BirthDate_BirthDate "
    "BirthDate_Year BirthDate_Place BirthDate_City BirthDate_Region BirthDate_CountryDescription "
    "BirthDate_CountryIso2Code Address_Street Address_City Address_Region Address_ZipCode "
    "Address_Place Address_CountryDescription Address_CountryIso2Code "
    "Citizenship_CountryDescription Citizenship_CountryIso2Code Identification_Number "
    "Identification_TypeDescription Identification_CountryDescription "
    "Identification_CountryIso2Code"
).split()
EU_DATE_COLUMNS = [
    "fileGenerationDate",
    "Entity_DesignationDate",
    "NameAlias_Regulation_PublicationDate",
    "BirthDate_BirthDate",
    "Entity_Regulation_PublicationDate",
    "Entity_Regulation_EntryIntoForceDate",
]

UN_INDIVIDUAL = (
    "DATAID string, REFERENCE_NUMBER string, FIRST_NAME string, SECOND_NAME string, "
    "THIRD_NAME string, FOURTH_NAME string, TITLE string, GENDER string, UN_LIST_TYPE string, "
    "LISTED_ON string, COMMENTS1 string, COMMENTS2 string, COMMENTS3 string, COMMENTS4 string, "
    "COMMENTS5 string, "
    "NATIONALITY struct<VALUE: array<string>>, LIST_TYPE struct<VALUE: array<string>>, "
    "LAST_DAY_UPDATED struct<VALUE: array<string>>, "
    "INDIVIDUAL_ALIAS array<struct<ALIAS_NAME: string, QUALITY: string>>, "
    "INDIVIDUAL_DATE_OF_BIRTH array<struct<DATE: string, YEAR: string>>, "
    "INDIVIDUAL_PLACE_OF_BIRTH array<struct<CITY: string, COUNTRY: string>>, "
    "INDIVIDUAL_ADDRESS array<struct<STREET: string, CITY: string, STATE_PROVINCE: string, "
    "ZIP_CODE: string, COUNTRY: string, NOTE: string>>, "
    "INDIVIDUAL_DOCUMENT array<struct<TYPE_OF_DOCUMENT: string, NUMBER: string, "
    "ISSUING_COUNTRY: string>>"
)

AML_REQUEST = "request_id string, full_name string, dob string, nationality string"
_DOCUMENT_DATA = (
    "struct<document_type: string, document_number: string, expiry_date: string, issue_date: string, "
    "issuing_country: string, first_name: string, last_name: string, date_of_birth: string, "
    "nationality: string, address: map<string, string>>"
)
KYC_REQUEST = (
    f"request_id string, document_data {_DOCUMENT_DATA}, document_image_base64 string, "
    "selfie_image_base64 string, metadata map<string, string>"
)
COMBINED_REQUEST = (
    "request_id string, aml_data struct<full_name: string, dob: string, nationality: string>, "
    f"kyc_data struct<document_data: {_DOCUMENT_DATA}, document_image_base64: string, "
    "selfie_image_base64: string, metadata: map<string, string>>"
)
AUDIT_EVENT = (
    "timestamp string, event_type string, status string, error string, request_id string, "
    "client_ip string, user_agent string, method string, url string, request_payload string, "
    "risk_score double, risk_level string, sanctions_match boolean, pep_match boolean, "
    "match_count bigint, verification_result string, document_verified boolean, "
    "face_match boolean, combined_risk_score double, combined_risk_level string, "
    "aml_sanctions_match boolean, kyc_document_verified boolean, kyc_face_match boolean"
)
EXTRACTION_RULE = (
    "country_code string, document_type string, extraction_patterns struct<document_number: string, "
    "name: string, date_of_birth: string, expiry_date: string>"
)
