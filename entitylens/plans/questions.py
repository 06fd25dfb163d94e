"""Example questions, for timings, tests and queries alike."""

from __future__ import annotations

QUESTIONS = [
    "Find fintech companies in Finland working on fraud detection or banking analytics.",
    "Show German healthcare companies focused on diagnostics and patient monitoring.",
    "Biotech startups in Germany working on drug discovery.",
    "Energy companies in Sweden building software for smart grids or renewable forecasting.",
    "US technology companies building infrastructure for data pipelines and observability.",
    "Show healthcare companies in Finland focused on diagnostics founded before 2005.",
    "Find telecom companies in the UK working on 5G analytics with fewer than 20 employees.",
    "Retail companies in France focused on pricing optimization and demand forecasting.",
    "Education companies in the UK using AI for personalized learning.",
    "Automotive software companies in Germany working on autonomous driving.",
    "Find fintech companies in Germany working on fraud detection with revenue over 500M.",
    "Find companies in Sweden with 50 to 250 employees working on energy forecasting.",
    "Find fintech companies in Finland founded after 2015 with revenue between 10M and 100M.",
    "Show German companies founded after 2018 with fewer than 100 employees working on drug discovery.",
    "Find UK education companies founded after 2019 with revenue under 10M.",
    "Find German biotech companies with more than 500 employees founded after 2022.",
    "Show retail companies in Norway focused on pricing optimization with revenue above 100M.",
]
