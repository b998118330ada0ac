"""What the two searches for nationalities must find, written out for the SQL they are checked with.

A line is a text to be found and the name it stands for; underscores at its ends are spaces.
"""


def _pairs(text: str) -> list[tuple[str, str]]:
    lines = [line.split(">") for line in text.strip().splitlines()]
    return [(found.replace("_", " "), name) for found, name in lines]


#: Two-letter codes between spaces, names, and other spellings.
OFAC_SEARCHED = _pairs(
    """
_AD_>ANDORRA
_AE_>UNITED ARAB EMIRATES
_AF_>AFGHANISTAN
_AG_>ANTIGUA AND BARBUDA
_AL_>ALBANIA
_AM_>ARMENIA
_AO_>ANGOLA
_AR_>ARGENTINA
_AT_>AUSTRIA
_AU_>AUSTRALIA
_AZ_>AZERBAIJAN
_BA_>BOSNIA AND HERZEGOVINA
_BB_>BARBADOS
_BD_>BANGLADESH
_BE_>BELGIUM
_BF_>BURKINA FASO
_BG_>BULGARIA
_BH_>BAHRAIN
_BI_>BURUNDI
_BJ_>BENIN
_BN_>BRUNEI DARUSSALAM
_BO_>BOLIVIA
_BR_>BRAZIL
_BS_>BAHAMAS
_BT_>BHUTAN
_BW_>BOTSWANA
_BY_>BELARUS
_BZ_>BELIZE
_CA_>CANADA
_CD_>CONGO, THE DEMOCRATIC REPUBLIC OF THE
_CF_>CENTRAL AFRICAN REPUBLIC
_CG_>CONGO
_CH_>SWITZERLAND
_CI_>COTE D'IVOIRE
_CL_>CHILE
_CM_>CAMEROON
_CN_>CHINA
_CO_>COLOMBIA
_CR_>COSTA RICA
_CU_>CUBA
_CV_>CABO VERDE
_CY_>CYPRUS
_CZ_>CZECH REPUBLIC
_DE_>GERMANY
_DJ_>DJIBOUTI
_DK_>DENMARK
_DM_>DOMINICA
_DO_>DOMINICAN REPUBLIC
_DZ_>ALGERIA
_EC_>ECUADOR
_EE_>ESTONIA
_EG_>EGYPT
_ER_>ERITREA
_ES_>SPAIN
_ET_>ETHIOPIA
_FI_>FINLAND
_FJ_>FIJI
_FM_>MICRONESIA, FEDERATED STATES OF
_FR_>FRANCE
_GA_>GABON
_GB_>UNITED KINGDOM
_GD_>GRENADA
_GE_>GEORGIA
_GH_>GHANA
_GM_>GAMBIA
_GN_>GUINEA
_GQ_>EQUATORIAL GUINEA
_GR_>GREECE
_GT_>GUATEMALA
_GW_>GUINEA-BISSAU
_GY_>GUYANA
_HN_>HONDURAS
_HR_>CROATIA
_HT_>HAITI
_HU_>HUNGARY
_ID_>INDONESIA
_IE_>IRELAND
_IL_>ISRAEL
_IN_>INDIA
_IQ_>IRAQ
_IR_>IRAN, ISLAMIC REPUBLIC OF
_IS_>ICELAND
_IT_>ITALY
_JM_>JAMAICA
_JO_>JORDAN
_JP_>JAPAN
_KE_>KENYA
_KG_>KYRGYZSTAN
_KH_>CAMBODIA
_KI_>KIRIBATI
_KM_>COMOROS
_KN_>SAINT KITTS AND NEVIS
_KP_>KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF
_KR_>KOREA, REPUBLIC OF
_KW_>KUWAIT
_KZ_>KAZAKHSTAN
_LA_>LAO PEOPLE'S DEMOCRATIC REPUBLIC
_LB_>LEBANON
_LC_>SAINT LUCIA
_LI_>LIECHTENSTEIN
_LK_>SRI LANKA
_LR_>LIBERIA
_LS_>LESOTHO
_LT_>LITHUANIA
_LU_>LUXEMBOURG
_LV_>LATVIA
_LY_>LIBYA
_MA_>MOROCCO
_MC_>MONACO
_MD_>MOLDOVA, REPUBLIC OF
_ME_>MONTENEGRO
_MG_>MADAGASCAR
_MH_>MARSHALL ISLANDS
_MK_>NORTH MACEDONIA
_ML_>MALI
_MM_>MYANMAR
_MN_>MONGOLIA
_MR_>MAURITANIA
_MT_>MALTA
_MU_>MAURITIUS
_MV_>MALDIVES
_MW_>MALAWI
_MX_>MEXICO
_MY_>MALAYSIA
_MZ_>MOZAMBIQUE
_NA_>NAMIBIA
_NE_>NIGER
_NG_>NIGERIA
_NI_>NICARAGUA
_NL_>NETHERLANDS
_NO_>NORWAY
_NP_>NEPAL
_NR_>NAURU
_NZ_>NEW ZEALAND
_OM_>OMAN
_PA_>PANAMA
_PE_>PERU
_PG_>PAPUA NEW GUINEA
_PH_>PHILIPPINES
_PK_>PAKISTAN
_PL_>POLAND
_PT_>PORTUGAL
_PW_>PALAU
_PY_>PARAGUAY
_QA_>QATAR
_RO_>ROMANIA
_RS_>SERBIA
_RU_>RUSSIAN FEDERATION
_RW_>RWANDA
_SA_>SAUDI ARABIA
_SB_>SOLOMON ISLANDS
_SC_>SEYCHELLES
_SD_>SUDAN
_SE_>SWEDEN
_SG_>SINGAPORE
_SI_>SLOVENIA
_SK_>SLOVAKIA
_SL_>SIERRA LEONE
_SM_>SAN MARINO
_SN_>SENEGAL
_SO_>SOMALIA
_SR_>SURINAME
_SS_>SOUTH SUDAN
_ST_>SAO TOME AND PRINCIPE
_SV_>EL SALVADOR
_SY_>SYRIAN ARAB REPUBLIC
_SZ_>ESWATINI
_TD_>CHAD
_TG_>TOGO
_TH_>THAILAND
_TJ_>TAJIKISTAN
_TL_>TIMOR-LESTE
_TM_>TURKMENISTAN
_TN_>TUNISIA
_TO_>TONGA
_TR_>TURKEY
_TT_>TRINIDAD AND TOBAGO
_TV_>TUVALU
_TW_>TAIWAN, PROVINCE OF CHINA
_TZ_>TANZANIA, UNITED REPUBLIC OF
_UA_>UKRAINE
_UG_>UGANDA
_US_>UNITED STATES
_UY_>URUGUAY
_UZ_>UZBEKISTAN
_VA_>HOLY SEE (VATICAN CITY STATE)
_VC_>SAINT VINCENT AND THE GRENADINES
_VE_>VENEZUELA, BOLIVARIAN REPUBLIC OF
_VN_>VIET NAM
_VU_>VANUATU
_WS_>SAMOA
_YE_>YEMEN
_ZA_>SOUTH AFRICA
_ZM_>ZAMBIA
_ZW_>ZIMBABWE
_XK_>KOSOVO
_UK_>UNITED KINGDOM
_00_>UNKNOWN
_XX_>UNKNOWN
_ZZ_>UNKNOWN
AFGHANISTAN>AFGHANISTAN
ALBANIA>ALBANIA
ALGERIA>ALGERIA
ANDORRA>ANDORRA
ANGOLA>ANGOLA
ANTIGUA AND BARBUDA>ANTIGUA AND BARBUDA
ARGENTINA>ARGENTINA
ARMENIA>ARMENIA
AUSTRALIA>AUSTRALIA
AUSTRIA>AUSTRIA
AZERBAIJAN>AZERBAIJAN
BAHAMAS>BAHAMAS
BAHRAIN>BAHRAIN
BANGLADESH>BANGLADESH
BARBADOS>BARBADOS
BELARUS>BELARUS
BELGIUM>BELGIUM
BELIZE>BELIZE
BENIN>BENIN
BHUTAN>BHUTAN
BOLIVIA>BOLIVIA
BOSNIA AND HERZEGOVINA>BOSNIA AND HERZEGOVINA
BOTSWANA>BOTSWANA
BRAZIL>BRAZIL
BRUNEI DARUSSALAM>BRUNEI DARUSSALAM
BULGARIA>BULGARIA
BURKINA FASO>BURKINA FASO
BURUNDI>BURUNDI
CABO VERDE>CABO VERDE
CAMBODIA>CAMBODIA
CAMEROON>CAMEROON
CANADA>CANADA
CENTRAL AFRICAN REPUBLIC>CENTRAL AFRICAN REPUBLIC
CHAD>CHAD
CHILE>CHILE
CHINA>CHINA
COLOMBIA>COLOMBIA
COMOROS>COMOROS
CONGO>CONGO
CONGO, THE DEMOCRATIC REPUBLIC OF THE>CONGO, THE DEMOCRATIC REPUBLIC OF THE
COSTA RICA>COSTA RICA
COTE D'IVOIRE>COTE D'IVOIRE
CROATIA>CROATIA
CUBA>CUBA
CYPRUS>CYPRUS
CZECH REPUBLIC>CZECH REPUBLIC
DENMARK>DENMARK
DJIBOUTI>DJIBOUTI
DOMINICA>DOMINICA
DOMINICAN REPUBLIC>DOMINICAN REPUBLIC
ECUADOR>ECUADOR
EGYPT>EGYPT
EL SALVADOR>EL SALVADOR
EQUATORIAL GUINEA>EQUATORIAL GUINEA
ERITREA>ERITREA
ESTONIA>ESTONIA
ESWATINI>ESWATINI
ETHIOPIA>ETHIOPIA
FIJI>FIJI
FINLAND>FINLAND
FRANCE>FRANCE
GABON>GABON
GAMBIA>GAMBIA
GEORGIA>GEORGIA
GERMANY>GERMANY
GHANA>GHANA
GREECE>GREECE
GRENADA>GRENADA
GUATEMALA>GUATEMALA
GUINEA>GUINEA
GUINEA-BISSAU>GUINEA-BISSAU
GUYANA>GUYANA
HAITI>HAITI
HOLY SEE (VATICAN CITY STATE)>HOLY SEE (VATICAN CITY STATE)
HONDURAS>HONDURAS
HONG KONG, CHINA>HONG KONG, CHINA
HUNGARY>HUNGARY
ICELAND>ICELAND
INDIA>INDIA
INDONESIA>INDONESIA
IRAN, ISLAMIC REPUBLIC OF>IRAN, ISLAMIC REPUBLIC OF
IRAQ>IRAQ
IRELAND>IRELAND
ISRAEL>ISRAEL
ITALY>ITALY
JAMAICA>JAMAICA
JAPAN>JAPAN
JORDAN>JORDAN
KAZAKHSTAN>KAZAKHSTAN
KENYA>KENYA
KIRIBATI>KIRIBATI
KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF>KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF
KOREA, REPUBLIC OF>KOREA, REPUBLIC OF
KOSOVO>KOSOVO
KUWAIT>KUWAIT
KYRGYZSTAN>KYRGYZSTAN
LAO PEOPLE'S DEMOCRATIC REPUBLIC>LAO PEOPLE'S DEMOCRATIC REPUBLIC
LATVIA>LATVIA
LEBANON>LEBANON
LESOTHO>LESOTHO
LIBERIA>LIBERIA
LIBYA>LIBYA
LIECHTENSTEIN>LIECHTENSTEIN
LITHUANIA>LITHUANIA
LUXEMBOURG>LUXEMBOURG
MACAO, CHINA>MACAO, CHINA
MADAGASCAR>MADAGASCAR
MALAWI>MALAWI
MALAYSIA>MALAYSIA
MALDIVES>MALDIVES
MALI>MALI
MALTA>MALTA
MARSHALL ISLANDS>MARSHALL ISLANDS
MAURITANIA>MAURITANIA
MAURITIUS>MAURITIUS
MEXICO>MEXICO
MICRONESIA, FEDERATED STATES OF>MICRONESIA, FEDERATED STATES OF
MOLDOVA, REPUBLIC OF>MOLDOVA, REPUBLIC OF
MONACO>MONACO
MONGOLIA>MONGOLIA
MONTENEGRO>MONTENEGRO
MOROCCO>MOROCCO
MOZAMBIQUE>MOZAMBIQUE
MULTIPLE>MULTIPLE
MYANMAR>MYANMAR
NAMIBIA>NAMIBIA
NAURU>NAURU
NEPAL>NEPAL
NETHERLANDS>NETHERLANDS
NEW ZEALAND>NEW ZEALAND
NICARAGUA>NICARAGUA
NIGER>NIGER
NIGERIA>NIGERIA
NORTH MACEDONIA>NORTH MACEDONIA
NORWAY>NORWAY
OMAN>OMAN
PAKISTAN>PAKISTAN
PALAU>PALAU
PALESTINE, STATE OF>PALESTINE, STATE OF
PANAMA>PANAMA
PAPUA NEW GUINEA>PAPUA NEW GUINEA
PARAGUAY>PARAGUAY
PERU>PERU
PHILIPPINES>PHILIPPINES
POLAND>POLAND
PORTUGAL>PORTUGAL
QATAR>QATAR
ROMANIA>ROMANIA
RUSSIAN FEDERATION>RUSSIAN FEDERATION
RWANDA>RWANDA
SAINT KITTS AND NEVIS>SAINT KITTS AND NEVIS
SAINT LUCIA>SAINT LUCIA
SAINT VINCENT AND THE GRENADINES>SAINT VINCENT AND THE GRENADINES
SAMOA>SAMOA
SAN MARINO>SAN MARINO
SAO TOME AND PRINCIPE>SAO TOME AND PRINCIPE
SAUDI ARABIA>SAUDI ARABIA
SENEGAL>SENEGAL
SERBIA>SERBIA
SEYCHELLES>SEYCHELLES
SIERRA LEONE>SIERRA LEONE
SINGAPORE>SINGAPORE
SLOVAKIA>SLOVAKIA
SLOVENIA>SLOVENIA
SOLOMON ISLANDS>SOLOMON ISLANDS
SOMALIA>SOMALIA
SOUTH AFRICA>SOUTH AFRICA
SOUTH SUDAN>SOUTH SUDAN
SPAIN>SPAIN
SRI LANKA>SRI LANKA
STATELESS>STATELESS
SUDAN>SUDAN
SURINAME>SURINAME
SWEDEN>SWEDEN
SWITZERLAND>SWITZERLAND
SYRIAN ARAB REPUBLIC>SYRIAN ARAB REPUBLIC
TAIWAN, PROVINCE OF CHINA>TAIWAN, PROVINCE OF CHINA
TAJIKISTAN>TAJIKISTAN
TANZANIA, UNITED REPUBLIC OF>TANZANIA, UNITED REPUBLIC OF
THAILAND>THAILAND
TIMOR-LESTE>TIMOR-LESTE
TOGO>TOGO
TONGA>TONGA
TRINIDAD AND TOBAGO>TRINIDAD AND TOBAGO
TUNISIA>TUNISIA
TURKEY>TURKEY
TURKMENISTAN>TURKMENISTAN
TUVALU>TUVALU
UGANDA>UGANDA
UKRAINE>UKRAINE
UNITED ARAB EMIRATES>UNITED ARAB EMIRATES
UNITED KINGDOM>UNITED KINGDOM
UNITED STATES>UNITED STATES
UNKNOWN>UNKNOWN
URUGUAY>URUGUAY
UZBEKISTAN>UZBEKISTAN
VANUATU>VANUATU
VENEZUELA, BOLIVARIAN REPUBLIC OF>VENEZUELA, BOLIVARIAN REPUBLIC OF
VIET NAM>VIET NAM
YEMEN>YEMEN
ZAMBIA>ZAMBIA
ZIMBABWE>ZIMBABWE
RUSSIA>RUSSIAN FEDERATION
IRAN>IRAN, ISLAMIC REPUBLIC OF
SOUTH KOREA>KOREA, REPUBLIC OF
ROK>KOREA, REPUBLIC OF
NORTH KOREA>KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF
DPRK>KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF
PRK>KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF
LAOS>LAO PEOPLE'S DEMOCRATIC REPUBLIC
BOSNIA>BOSNIA AND HERZEGOVINA
BURMA>MYANMAR
CZECHIA>CZECH REPUBLIC
MACEDONIA>NORTH MACEDONIA
PALESTINE>PALESTINE, STATE OF
REPUBLIC OF THE CONGO>CONGO
DEMOCRATIC REPUBLIC OF THE CONGO>CONGO, THE DEMOCRATIC REPUBLIC OF THE
EAST TIMOR>TIMOR-LESTE
SWAZILAND>ESWATINI
IVORY COAST>COTE D'IVOIRE
CAPE VERDE>CABO VERDE
VIETNAM>VIET NAM
TAIWAN>TAIWAN, PROVINCE OF CHINA
VATICAN>HOLY SEE (VATICAN CITY STATE)
VATICAN CITY>HOLY SEE (VATICAN CITY STATE)
HOLY SEE>HOLY SEE (VATICAN CITY STATE)
UNITED STATES OF AMERICA>UNITED STATES
USA>UNITED STATES
US>UNITED STATES
UK>UNITED KINGDOM
UAE>UNITED ARAB EMIRATES
VENEZUELA>VENEZUELA, BOLIVARIAN REPUBLIC OF
BOLIVIA>BOLIVIA, PLURINATIONAL STATE OF
MOLDOVA>MOLDOVA, REPUBLIC OF
TANZANIA>TANZANIA, UNITED REPUBLIC OF
MICRONESIA>MICRONESIA, FEDERATED STATES OF
FEDERATED STATES OF MICRONESIA>MICRONESIA, FEDERATED STATES OF
ST. VINCENT AND THE GRENADINES>SAINT VINCENT AND THE GRENADINES
ST. VINCENT & THE GRENADINES>SAINT VINCENT AND THE GRENADINES
SAINT VINCENT>SAINT VINCENT AND THE GRENADINES
SAINT VINCENT & GRENADINES>SAINT VINCENT AND THE GRENADINES
ST. KITTS AND NEVIS>SAINT KITTS AND NEVIS
ST. KITTS & NEVIS>SAINT KITTS AND NEVIS
SAINT KITTS>SAINT KITTS AND NEVIS
SAINT KITTS & NEVIS>SAINT KITTS AND NEVIS
ST. LUCIA>SAINT LUCIA
SAINT LUCIA>SAINT LUCIA
SAO TOME>SAO TOME AND PRINCIPE
SAO TOME & PRINCIPE>SAO TOME AND PRINCIPE
SVALBARD AND JAN MAYEN>NORWAY
BRITISH VIRGIN ISLANDS>VIRGIN ISLANDS, BRITISH
US VIRGIN ISLANDS>VIRGIN ISLANDS, U.S.
U.S. VIRGIN ISLANDS>VIRGIN ISLANDS, U.S.
UNITED STATES VIRGIN ISLANDS>VIRGIN ISLANDS, U.S.
U.S. MINOR OUTLYING ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES MINOR OUTLYING ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
U.S. OUTLYING ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES OUTLYING ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
U.S. MINOR ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES MINOR ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
U.S. PACIFIC ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES PACIFIC ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
U.S. PACIFIC TERRITORIES>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES PACIFIC TERRITORIES>UNITED STATES MINOR OUTLYING ISLANDS
U.S. TERRITORIES>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES TERRITORIES>UNITED STATES MINOR OUTLYING ISLANDS
U.S. TERRITORY>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES TERRITORY>UNITED STATES MINOR OUTLYING ISLANDS
U.S. ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES ISLANDS>UNITED STATES MINOR OUTLYING ISLANDS
U.S. ISLAND TERRITORIES>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES ISLAND TERRITORIES>UNITED STATES MINOR OUTLYING ISLANDS
U.S. ISLAND TERRITORY>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES ISLAND TERRITORY>UNITED STATES MINOR OUTLYING ISLANDS
U.S. PACIFIC ISLAND TERRITORIES>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES PACIFIC ISLAND TERRITORIES>UNITED STATES MINOR OUTLYING ISLANDS
U.S. PACIFIC ISLAND TERRITORY>UNITED STATES MINOR OUTLYING ISLANDS
UNITED STATES PACIFIC ISLAND TERRITORY>UNITED STATES MINOR OUTLYING ISLANDS
"""
)

#: Names and other spellings, as whole words.
UK_SEARCHED = _pairs(
    """
AFGHANISTAN>AFGHANISTAN
ALBANIA>ALBANIA
ALGERIA>ALGERIA
ANDORRA>ANDORRA
ANGOLA>ANGOLA
ANTIGUA AND BARBUDA>ANTIGUA AND BARBUDA
ARGENTINA>ARGENTINA
ARMENIA>ARMENIA
AUSTRALIA>AUSTRALIA
AUSTRIA>AUSTRIA
AZERBAIJAN>AZERBAIJAN
BAHAMAS>BAHAMAS
BAHRAIN>BAHRAIN
BANGLADESH>BANGLADESH
BARBADOS>BARBADOS
BELARUS>BELARUS
BELGIUM>BELGIUM
BELIZE>BELIZE
BENIN>BENIN
BHUTAN>BHUTAN
BOLIVIA>BOLIVIA
BOSNIA AND HERZEGOVINA>BOSNIA AND HERZEGOVINA
BOTSWANA>BOTSWANA
BRAZIL>BRAZIL
BRUNEI DARUSSALAM>BRUNEI DARUSSALAM
BULGARIA>BULGARIA
BURKINA FASO>BURKINA FASO
BURUNDI>BURUNDI
CABO VERDE>CABO VERDE
CAMBODIA>CAMBODIA
CAMEROON>CAMEROON
CANADA>CANADA
CENTRAL AFRICAN REPUBLIC>CENTRAL AFRICAN REPUBLIC
CHAD>CHAD
CHILE>CHILE
CHINA>CHINA
COLOMBIA>COLOMBIA
COMOROS>COMOROS
CONGO>CONGO
CONGO, THE DEMOCRATIC REPUBLIC OF THE>CONGO, THE DEMOCRATIC REPUBLIC OF THE
COSTA RICA>COSTA RICA
COTE D'IVOIRE>COTE D'IVOIRE
CROATIA>CROATIA
CUBA>CUBA
CYPRUS>CYPRUS
CZECH REPUBLIC>CZECH REPUBLIC
DENMARK>DENMARK
DJIBOUTI>DJIBOUTI
DOMINICA>DOMINICA
DOMINICAN REPUBLIC>DOMINICAN REPUBLIC
ECUADOR>ECUADOR
EGYPT>EGYPT
EL SALVADOR>EL SALVADOR
EQUATORIAL GUINEA>EQUATORIAL GUINEA
ERITREA>ERITREA
ESTONIA>ESTONIA
ESWATINI>ESWATINI
ETHIOPIA>ETHIOPIA
FIJI>FIJI
FINLAND>FINLAND
FRANCE>FRANCE
GABON>GABON
GAMBIA>GAMBIA
GEORGIA>GEORGIA
GERMANY>GERMANY
GHANA>GHANA
GREECE>GREECE
GRENADA>GRENADA
GUATEMALA>GUATEMALA
GUINEA>GUINEA
GUINEA-BISSAU>GUINEA-BISSAU
GUYANA>GUYANA
HAITI>HAITI
HOLY SEE (VATICAN CITY STATE)>HOLY SEE (VATICAN CITY STATE)
HONDURAS>HONDURAS
HUNGARY>HUNGARY
ICELAND>ICELAND
INDIA>INDIA
INDONESIA>INDONESIA
IRAN, ISLAMIC REPUBLIC OF>IRAN, ISLAMIC REPUBLIC OF
IRAQ>IRAQ
IRELAND>IRELAND
ISRAEL>ISRAEL
ITALY>ITALY
JAMAICA>JAMAICA
JAPAN>JAPAN
JORDAN>JORDAN
KAZAKHSTAN>KAZAKHSTAN
KENYA>KENYA
KIRIBATI>KIRIBATI
KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF>KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF
KOREA, REPUBLIC OF>KOREA, REPUBLIC OF
KOSOVO>KOSOVO
KUWAIT>KUWAIT
KYRGYZSTAN>KYRGYZSTAN
LAO PEOPLE'S DEMOCRATIC REPUBLIC>LAO PEOPLE'S DEMOCRATIC REPUBLIC
LATVIA>LATVIA
LEBANON>LEBANON
LESOTHO>LESOTHO
LIBERIA>LIBERIA
LIBYA>LIBYA
LIECHTENSTEIN>LIECHTENSTEIN
LITHUANIA>LITHUANIA
LUXEMBOURG>LUXEMBOURG
MADAGASCAR>MADAGASCAR
MALAWI>MALAWI
MALAYSIA>MALAYSIA
MALDIVES>MALDIVES
MALI>MALI
MALTA>MALTA
MARSHALL ISLANDS>MARSHALL ISLANDS
MAURITANIA>MAURITANIA
MAURITIUS>MAURITIUS
MEXICO>MEXICO
MICRONESIA, FEDERATED STATES OF>MICRONESIA, FEDERATED STATES OF
MOLDOVA, REPUBLIC OF>MOLDOVA, REPUBLIC OF
MONACO>MONACO
MONGOLIA>MONGOLIA
MONTENEGRO>MONTENEGRO
MOROCCO>MOROCCO
MOZAMBIQUE>MOZAMBIQUE
MYANMAR>MYANMAR
NAMIBIA>NAMIBIA
NAURU>NAURU
NEPAL>NEPAL
NETHERLANDS>NETHERLANDS
NEW ZEALAND>NEW ZEALAND
NICARAGUA>NICARAGUA
NIGER>NIGER
NIGERIA>NIGERIA
NORTH MACEDONIA>NORTH MACEDONIA
NORWAY>NORWAY
OMAN>OMAN
PAKISTAN>PAKISTAN
PALAU>PALAU
PALESTINE, STATE OF>PALESTINE, STATE OF
PANAMA>PANAMA
PAPUA NEW GUINEA>PAPUA NEW GUINEA
PARAGUAY>PARAGUAY
PERU>PERU
PHILIPPINES>PHILIPPINES
POLAND>POLAND
PORTUGAL>PORTUGAL
QATAR>QATAR
ROMANIA>ROMANIA
RUSSIAN FEDERATION>RUSSIAN FEDERATION
RWANDA>RWANDA
SAINT KITTS AND NEVIS>SAINT KITTS AND NEVIS
SAINT LUCIA>SAINT LUCIA
SAINT VINCENT AND THE GRENADINES>SAINT VINCENT AND THE GRENADINES
SAMOA>SAMOA
SAN MARINO>SAN MARINO
SAO TOME AND PRINCIPE>SAO TOME AND PRINCIPE
SAUDI ARABIA>SAUDI ARABIA
SENEGAL>SENEGAL
SERBIA>SERBIA
SEYCHELLES>SEYCHELLES
SIERRA LEONE>SIERRA LEONE
SINGAPORE>SINGAPORE
SLOVAKIA>SLOVAKIA
SLOVENIA>SLOVENIA
SOLOMON ISLANDS>SOLOMON ISLANDS
SOMALIA>SOMALIA
SOUTH AFRICA>SOUTH AFRICA
SOUTH SUDAN>SOUTH SUDAN
SPAIN>SPAIN
SRI LANKA>SRI LANKA
SUDAN>SUDAN
SURINAME>SURINAME
SWEDEN>SWEDEN
SWITZERLAND>SWITZERLAND
SYRIAN ARAB REPUBLIC>SYRIAN ARAB REPUBLIC
TAIWAN, PROVINCE OF CHINA>TAIWAN, PROVINCE OF CHINA
TAJIKISTAN>TAJIKISTAN
TANZANIA, UNITED REPUBLIC OF>TANZANIA, UNITED REPUBLIC OF
THAILAND>THAILAND
TIMOR-LESTE>TIMOR-LESTE
TOGO>TOGO
TONGA>TONGA
TRINIDAD AND TOBAGO>TRINIDAD AND TOBAGO
TUNISIA>TUNISIA
TURKEY>TURKEY
TURKMENISTAN>TURKMENISTAN
TUVALU>TUVALU
UGANDA>UGANDA
UKRAINE>UKRAINE
UNITED ARAB EMIRATES>UNITED ARAB EMIRATES
UNITED KINGDOM>UNITED KINGDOM
UNITED STATES>UNITED STATES
URUGUAY>URUGUAY
UZBEKISTAN>UZBEKISTAN
VANUATU>VANUATU
VENEZUELA, BOLIVARIAN REPUBLIC OF>VENEZUELA, BOLIVARIAN REPUBLIC OF
VIET NAM>VIET NAM
YEMEN>YEMEN
ZAMBIA>ZAMBIA
ZIMBABWE>ZIMBABWE
UK>UNITED KINGDOM
UK>UK
USA>UNITED STATES
USA>USA
UAE>UNITED ARAB EMIRATES
UAE>UAE
U.S.>UNITED STATES
U.S.>U.S.
U.S.A.>UNITED STATES
U.S.A.>U.S.A.
U.K.>UNITED KINGDOM
U.K.>U.K.
SOUTH KOREA>KOREA, REPUBLIC OF
SOUTH KOREA>SOUTH KOREA
NORTH KOREA>KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF
NORTH KOREA>NORTH KOREA
RUSSIA>RUSSIAN FEDERATION
RUSSIA>RUSSIA
PALESTINIAN>PALESTINE, STATE OF
PALESTINIAN>PALESTINIAN
TAIWANESE>TAIWAN, PROVINCE OF CHINA
TAIWANESE>TAIWANESE
HONG KONG>HONG KONG, CHINA
MACAU>MACAO, CHINA
MACAO>MACAO, CHINA
BURMA>MYANMAR
BURMA>BURMA
VIETNAM>VIET NAM
VIETNAM>VIETNAM
BOSNIA>BOSNIA AND HERZEGOVINA
BOSNIA>BOSNIA
IVORY COAST>COTE D'IVOIRE
IVORY COAST>IVORY COAST
EAST TIMOR>TIMOR-LESTE
EAST TIMOR>EAST TIMOR
SWAZILAND>ESWATINI
SWAZILAND>SWAZILAND
CZECHIA>CZECH REPUBLIC
CZECHIA>CZECHIA
SLOVAK REPUBLIC>SLOVAKIA
SLOVAK REPUBLIC>SLOVAK REPUBLIC
MACEDONIA>NORTH MACEDONIA
MACEDONIA>MACEDONIA
REPUBLIC OF MOLDOVA>MOLDOVA, REPUBLIC OF
REPUBLIC OF MOLDOVA>REPUBLIC OF MOLDOVA
DEMOCRATIC REPUBLIC OF THE CONGO>CONGO, THE DEMOCRATIC REPUBLIC OF THE
DEMOCRATIC REPUBLIC OF THE CONGO>DEMOCRATIC REPUBLIC OF THE CONGO
REPUBLIC OF THE CONGO>CONGO
REPUBLIC OF THE CONGO>REPUBLIC OF THE CONGO
VATICAN>HOLY SEE (VATICAN CITY STATE)
VATICAN>VATICAN
"""
)
