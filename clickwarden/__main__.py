from clickwarden.streaming.app import main

main()
