"""Canonical names of entities by alias, as a table to join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import squeeze, strip

# Alias in lower case -> canonical name, by kind; for graph nodes and, below, for extracted records.
# fmt: off
GRAPH = {
    "institution": {
        "mit": "Massachusetts Institute of Technology", "massachusetts institute of technology": "Massachusetts Institute of Technology",
        "stanford": "Stanford University", "stanford university": "Stanford University",
        "uc berkeley": "UC Berkeley", "berkeley": "UC Berkeley", "university of california berkeley": "UC Berkeley",
        "cmu": "Carnegie Mellon University", "carnegie mellon": "Carnegie Mellon University",
        "oxford": "University of Oxford", "university of oxford": "University of Oxford",
        "cambridge": "University of Cambridge", "university of cambridge": "University of Cambridge",
        "google": "Google", "google research": "Google", "google brain": "Google",
        "google deepmind": "Google DeepMind", "deepmind": "Google DeepMind",
        "microsoft": "Microsoft", "microsoft research": "Microsoft",
        "meta": "Meta", "meta ai": "Meta", "facebook": "Meta", "facebook ai research": "Meta", "fair": "Meta",
        "openai": "OpenAI",
        "nvidia": "NVIDIA",
        "ibm": "IBM", "ibm research": "IBM",
        "amazon": "Amazon", "aws": "Amazon",
    },
    "methodology": {
        "transformer": "Transformer", "transformers": "Transformer",
        "cnn": "CNN", "convolutional neural network": "CNN", "convolutional neural networks": "CNN",
        "rnn": "RNN", "recurrent neural network": "RNN", "recurrent neural networks": "RNN",
        "lstm": "LSTM", "long short-term memory": "LSTM",
        "gpt": "GPT",
        "bert": "BERT",
        "diffusion": "Diffusion", "diffusion model": "Diffusion", "diffusion models": "Diffusion",
        "reinforcement learning": "Reinforcement Learning", "rl": "Reinforcement Learning",
        "transfer learning": "Transfer Learning",
        "fine-tuning": "Fine-tuning", "fine tuning": "Fine-tuning",
        "prompting": "Prompting", "prompt engineering": "Prompting",
        "few-shot": "Few-shot Learning", "few shot": "Few-shot Learning",
        "zero-shot": "Zero-shot Learning", "zero shot": "Zero-shot Learning",
    },
    "dataset": {
        "imagenet": "ImageNet",
        "coco": "COCO", "ms coco": "COCO",
        "squad": "SQuAD", "squad2": "SQuAD",
        "glue": "GLUE",
        "superglue": "SuperGLUE",
        "mnist": "MNIST",
        "cifar10": "CIFAR-10", "cifar-10": "CIFAR-10",
        "cifar100": "CIFAR-100", "cifar-100": "CIFAR-100",
        "wmt": "WMT",
        "wikitext": "WikiText",
        "wikitext103": "WikiText-103", "wikitext-103": "WikiText-103",
    },
    "technology": {
        "pytorch": "PyTorch", "torch": "PyTorch",
        "tensorflow": "TensorFlow", "tf": "TensorFlow",
        "jax": "JAX",
        "huggingface": "Hugging Face Transformers", "hugging face": "Hugging Face Transformers", "transformers": "Hugging Face Transformers",
        "langchain": "LangChain",
        "cuda": "CUDA",
    },
    "metric": {
        "accuracy": "Accuracy",
        "precision": "Precision",
        "recall": "Recall",
        "f1": "F1", "f1 score": "F1", "f1-score": "F1",
        "bleu": "BLEU",
        "rouge": "ROUGE", "rouge-l": "ROUGE",
        "perplexity": "Perplexity", "ppl": "Perplexity",
        "mae": "MAE", "mean absolute error": "MAE",
        "rmse": "RMSE",
        "mse": "MSE", "mean squared error": "MSE",
        "auc": "AUC", "auc-roc": "AUC",
        "map": "mAP", "mean average precision": "mAP",
        "ndcg": "NDCG",
        "latency": "Latency", "inference time": "Latency",
        "throughput": "Throughput",
    },
}
EXTRACTION = {
    "institution": {
        "mit": "Massachusetts Institute of Technology",
        "caltech": "California Institute of Technology",
        "ucla": "University of California, Los Angeles",
        "uc berkeley": "University of California, Berkeley", "ucb": "University of California, Berkeley",
        "uc san diego": "University of California, San Diego", "ucsd": "University of California, San Diego",
        "ucsf": "University of California, San Francisco",
        "nyu": "New York University",
        "cmu": "Carnegie Mellon University",
        "uiuc": "University of Illinois Urbana-Champaign",
        "ut austin": "University of Texas at Austin", "uta": "University of Texas at Austin",
        "ucl": "University College London",
        "imperial": "Imperial College London",
        "eth zurich": "ETH Zurich", "ethz": "ETH Zurich",
        "epfl": "École Polytechnique Fédérale de Lausanne",
        "kaist": "KAIST",
        "nus": "National University of Singapore",
        "hku": "University of Hong Kong",
        "tum": "Technical University of Munich",
        "mpi": "Max Planck Institute",
        "cambridge": "University of Cambridge",
        "oxford": "University of Oxford",
        "stanford": "Stanford University",
        "harvard": "Harvard University",
    },
    "dataset": {
        "imagenet": "ImageNet",
        "cifar-10": "CIFAR-10", "cifar10": "CIFAR-10",
        "cifar-100": "CIFAR-100", "cifar100": "CIFAR-100",
        "mnist": "MNIST",
        "fashion-mnist": "Fashion-MNIST", "fashion mnist": "Fashion-MNIST",
        "svhn": "SVHN",
        "squad": "SQuAD", "squad1": "SQuAD",
        "squad2": "SQuAD 2.0",
        "glue": "GLUE",
        "superglue": "SuperGLUE",
        "coco": "COCO", "ms coco": "COCO", "mscoco": "COCO",
        "cityscapes": "Cityscapes",
        "pascal voc": "PASCAL VOC",
        "pascal voc 2012": "PASCAL VOC 2012",
        "wn18": "WN18",
        "wn18rr": "WN18RR",
        "fb15k": "FB15k",
        "fb15k-237": "FB15k-237",
        "freebase": "Freebase",
        "wikidata": "Wikidata",
        "amazon review": "Amazon Review",
    },
    "technology": {
        "pytorch": "PyTorch",
        "tensorflow": "TensorFlow", "tf": "TensorFlow",
        "jax": "JAX",
        "keras": "Keras",
        "scikit-learn": "scikit-learn", "sklearn": "scikit-learn",
        "scipy": "SciPy",
        "numpy": "NumPy",
        "pandas": "pandas",
        "matplotlib": "Matplotlib",
        "huggingface": "Hugging Face", "hugging face": "Hugging Face",
        "transformers": "Transformers (Hugging Face)",
        "opencv": "OpenCV",
        "nltk": "NLTK",
        "spacy": "spaCy",
        "gensim": "Gensim",
        "django": "Django",
        "flask": "Flask",
        "react": "React",
        "angular": "Angular",
        "cuda": "CUDA",
        "docker": "Docker",
        "kubernetes": "Kubernetes",
        "git": "Git",
        "bert": "BERT",
        "gpt": "GPT",
        "gpt-3": "GPT-3",
        "gpt-4": "GPT-4",
        "roberta": "RoBERTa",
        "xlnet": "XLNet",
        "t5": "T5",
        "bart": "BART",
        "deberta": "DeBERTa",
        "llama": "LLaMA",
        "llama2": "LLaMA 2",
        "llama3": "LLaMA 3",
        "mistral": "Mistral",
        "mixtral": "Mixtral",
        "falcon": "Falcon",
        "gemma": "Gemma",
    },
}
# fmt: on


def rows(table: dict[str, dict[str, str]]) -> list[tuple[str, str, str]]:
    return [(kind, alias, name) for kind, names in table.items() for alias, name in names.items()]


def alias_table(spark: SparkSession, table: dict[str, dict[str, str]], more: list[tuple[str, str, str]] = ()) -> DataFrame:
    """kind, alias, canonical; more: further (kind, alias, canonical)"""
    own = {(k, a): (k, a, c) for k, a, c in [*rows(table), *((k, a.strip().lower(), c) for k, a, c in more)]}
    return spark.createDataFrame(list(own.values()), "kind string, alias string, canonical string")


def resolved(df: DataFrame, kind: str, name: str, table: dict[str, dict[str, str]], more: list[tuple[str, str, str]] = (), squeezed: bool = False, out: str = "resolved") -> DataFrame:
    """df with the canonical name for (kind, name) columns: by lower-cased alias, else the stripped name itself."""
    clean = squeeze(F.col(name)) if squeezed else strip(F.col(name))
    known = F.broadcast(alias_table(df.sparkSession, table, more))  # a fixed table of under 200 rows
    known = known.withColumnRenamed("kind", "_kind")
    joined = df.withColumn("_clean", clean).join(known, (F.col(kind) == F.col("_kind")) & (F.lower("_clean") == F.col("alias")), "left").drop("_kind")
    return joined.withColumn(out, F.coalesce("canonical", "_clean")).drop("_clean", "alias", "canonical")


def values_sql(table: dict[str, dict[str, str]]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({quoted(k)}, {quoted(a)}, {quoted(c)})" for k, a, c in rows(table)) + ") AS aliases(kind, alias, canonical)"
