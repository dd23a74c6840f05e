"""Names and types of the tables. Official column names are matched exactly, typos included."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def strings(names: list[str]) -> T.StructType:
    """Schema of a delimited file: every column is text and is cast explicitly later."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Headerless register files, columns in file order.
REGISTER_PARTNERS = [
    "cnpj_basico", "identificador_socio", "nome_socio", "cnpj_cpf_socio", "qualificacao_socio",
    "data_entrada", "pais", "representante_legal", "nome_representante",
    "qualificacao_representante", "faixa_etaria",
]
REGISTER_COMPANIES = [
    "cnpj_basico", "razao_social", "natureza_juridica", "qualificacao_responsavel",
    "capital_social", "porte", "ente_federativo",
]
REGISTER_ESTABLISHMENTS = [
    "cnpj_basico", "cnpj_ordem", "cnpj_dv", "matriz_filial", "nome_fantasia",
    "situacao_cadastral", "data_situacao_cadastral", "motivo_situacao", "cidade_exterior", "pais",
    "data_inicio_atividade", "cnae_principal", "cnae_secundaria", "tipo_logradouro", "logradouro",
    "numero", "complemento", "bairro", "cep", "uf", "municipio", "ddd1", "telefone1", "ddd2",
    "telefone2", "ddd_fax", "fax", "email", "situacao_especial", "data_situacao_especial",
]

SANCTIONS = T.StructType(
    [
        T.StructField("fonte", T.StringType()),
        T.StructField("tipo_pessoa", T.StringType()),
        T.StructField("cnpj_cpf", T.StringType()),
        T.StructField("nome", T.StringType()),
        T.StructField("nome_normalizado", T.StringType()),
        T.StructField("categoria", T.StringType()),
        T.StructField("orgao", T.StringType()),
        T.StructField("uf_orgao", T.StringType()),
        T.StructField("esfera_orgao", T.StringType()),
        T.StructField("data_inicio", T.DateType()),
        T.StructField("data_fim", T.DateType()),
        T.StructField("processo", T.StringType()),
        T.StructField("fundamentacao", T.StringType()),
        T.StructField("valor_multa", MONEY),
        T.StructField("vigente", T.BooleanType()),
    ]
)

CONTRACTS = T.StructType(
    [
        T.StructField("origem", T.StringType()),
        T.StructField("esfera", T.StringType()),
        T.StructField("competencia", T.StringType()),
        T.StructField("numero_contrato", T.StringType()),
        T.StructField("orgao_codigo", T.StringType()),
        T.StructField("orgao", T.StringType()),
        T.StructField("orgao_superior", T.StringType()),
        T.StructField("ug_codigo", T.StringType()),
        T.StructField("ug", T.StringType()),
        T.StructField("uf", T.StringType()),
        T.StructField("municipio_codigo_ibge", T.StringType()),
        T.StructField("cnpj_contratado", T.StringType()),
        T.StructField("nome_contratado", T.StringType()),
        T.StructField("nome_contratado_normalizado", T.StringType()),
        T.StructField("objeto", T.StringType()),
        T.StructField("situacao", T.StringType()),
        T.StructField("modalidade", T.StringType()),
        T.StructField("valor_inicial", MONEY),
        T.StructField("valor_final", MONEY),
        T.StructField("data_assinatura", T.DateType()),
        T.StructField("data_inicio_vigencia", T.DateType()),
        T.StructField("data_fim_vigencia", T.DateType()),
    ]
)

PARTNERS = T.StructType(
    [
        T.StructField("cnpj_basico", T.StringType()),
        T.StructField("identificador_socio", T.StringType()),
        T.StructField("nome_socio", T.StringType()),
        T.StructField("cpf_mascarado", T.StringType()),
        T.StructField("qualificacao", T.StringType()),
        T.StructField("data_entrada", T.DateType()),
        T.StructField("chave_socio", T.StringType()),
    ]
)

COMPANIES = T.StructType(
    [
        T.StructField("cnpj_basico", T.StringType()),
        T.StructField("razao_social", T.StringType()),
        T.StructField("natureza_juridica", T.StringType()),
        T.StructField("capital_social", MONEY),
        T.StructField("porte", T.StringType()),
    ]
)

ESTABLISHMENTS = T.StructType(
    [
        T.StructField("cnpj", T.StringType()),
        T.StructField("cnpj_basico", T.StringType()),
        T.StructField("matriz_filial", T.StringType()),
        T.StructField("nome_fantasia", T.StringType()),
        T.StructField("situacao_cadastral", T.StringType()),
        T.StructField("data_inicio_atividade", T.DateType()),
        T.StructField("cnae_principal", T.StringType()),
        T.StructField("uf", T.StringType()),
        T.StructField("municipio_codigo", T.StringType()),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("cnpj_a", T.StringType()),
        T.StructField("cnpj_b", T.StringType()),
        T.StructField("socio_comum", T.StringType()),
        T.StructField("confianca", T.StringType()),
    ]
)

RISK = T.StructType(
    [
        T.StructField("cnpj_basico", T.StringType()),
        T.StructField("grau", T.IntegerType()),
        T.StructField("relacionada", T.StringType()),
        T.StructField("socio_comum", T.StringType()),
        T.StructField("confianca", T.StringType()),
        T.StructField("indicio_sucessora", T.BooleanType()),
    ]
)

# One contract record as published in JSON, and the page that carries a list of them.
CONTRACT_RECORD = T.StructType(
    [
        T.StructField("numeroControlePNCP", T.StringType()),
        T.StructField(
            "orgaoEntidade",
            T.StructType(
                [
                    T.StructField("cnpj", T.StringType()),
                    T.StructField("razaoSocial", T.StringType()),
                    T.StructField("esferaId", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "unidadeOrgao",
            T.StructType(
                [
                    T.StructField("codigoUnidade", T.StringType()),
                    T.StructField("nomeUnidade", T.StringType()),
                    T.StructField("ufSigla", T.StringType()),
                    T.StructField("codigoIbge", T.StringType()),
                ]
            ),
        ),
        T.StructField("niFornecedor", T.StringType()),
        T.StructField("nomeRazaoSocialFornecedor", T.StringType()),
        T.StructField("objetoContrato", T.StringType()),
        T.StructField(
            "tipoContrato",
            T.StructType(
                [T.StructField("id", T.IntegerType()), T.StructField("nome", T.StringType())]
            ),
        ),
        # read as decimal so that money never passes through a float
        T.StructField("valorInicial", MONEY),
        T.StructField("valorGlobal", MONEY),
        T.StructField("dataAssinatura", T.StringType()),
        T.StructField("dataVigenciaInicio", T.StringType()),
        T.StructField("dataVigenciaFim", T.StringType()),
    ]
)
PROCUREMENT_RECORD = T.StructType(
    [
        T.StructField("numeroControlePNCP", T.StringType()),
        T.StructField("modalidadeId", T.IntegerType()),
        T.StructField("objetoCompra", T.StringType()),
    ]
)


def page_of(record: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("data", T.ArrayType(record)),
            T.StructField("totalPaginas", T.IntegerType()),
        ]
    )


# Procurement modality codes.
MODALITIES = {
    1: "Leilão - Eletrônico",
    2: "Diálogo Competitivo",
    3: "Concurso",
    4: "Concorrência - Eletrônica",
    5: "Concorrência - Presencial",
    6: "Pregão - Eletrônico",
    7: "Pregão - Presencial",
    8: "Dispensa",
    9: "Inexigibilidade",
    10: "Manifestação de Interesse",
    11: "Pré-qualificação",
    12: "Credenciamento",
    13: "Leilão - Presencial",
    14: "Inaplicabilidade da Licitação",
}
